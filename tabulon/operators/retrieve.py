"""Passages of documents, and the search over them."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import lexical_tokens
from ..functions.vectors import lexical_vector
from .layout import ROWS_HELD, WORDS_HELD, edges, spanned

TARGET, LONGEST, OVERLAP, RUNT = 110, 160, 1, 25
TOP, FLOOR, BOOST, MOST_BOOST, QUESTIONS = 8, 0.25, 0.02, 0.1, 10_000
VECTORS = 8_192


def cut_lines(counts: list[int]) -> list[tuple[int, int]]:
    """(first line, end line) of passages over lines of so many words each.

    From the running totals of the words: a passage ends with the line that brings it to TARGET words, or before the line that
    would bring it beyond LONGEST, and takes one new line at least. The next one begins with the last OVERLAP lines again.
    """
    total = [0, *accumulate(counts)]
    out, first, fresh = [], 0, 0
    while fresh < len(counts):
        enough, most = bisect_left(total, total[first] + TARGET), bisect_right(total, total[first] + LONGEST) - 1
        end = min(len(counts), max(fresh + 1, min(enough, most)))
        out.append((first, end))
        first, fresh = max(0, end - OVERLAP), end
    return out


def passages_of(spans: list[tuple[str, int | None, int | None]]) -> list[tuple[str, int, int, int | None, int | None]]:
    """(text, first line, end line, first word, end word) of a page's lines (text, first word, end word).

    A last passage under TARGET that says nothing beyond the one before it is left out; one under RUNT words joins the one before it, the
    repeated line included. Words run from the first line that has a range to the last.
    """
    lines = [s for s in spans if s[0].strip()]
    counts = [(b - a if a is not None else 0) or len(text.split()) for text, a, b in lines]
    out: list[list] = []
    for first, end in cut_lines(counts):
        text = "\n".join(x[0] for x in lines[first:end]).strip()
        if out and end == len(lines) and sum(counts[first:end]) < TARGET and text in out[-1][0]:
            continue
        placed = [x for x in lines[first:end] if x[1] is not None]
        out.append([text, first, end, placed[0][1] if placed else None, placed[-1][2] if placed else None])
    merged: list[list] = []
    for p in out:
        if merged and len(p[0].split()) < RUNT:
            last = merged[-1]
            merged[-1] = [f"{last[0]}\n{p[0]}", last[1], p[2], p[3] if last[3] is None else last[3], last[4] if p[4] is None else p[4]]
        else:
            merged.append(p)
    return [tuple(p) for p in merged]


def chunk_pages(pages: DataFrame) -> DataFrame:
    """(document_id, page_index, ordinal, text, line_start, line_end, word_start, word_end, words); ordinals count through the document.

    pages: document_id, page_index and either lines, an array of texts, or words and lines with boxes, as of operators.layout; then a
    passage has the range of its words on the page, which operators.layout.cite takes. A page's passages depend on that page
    alone, so they are one pass; the ordinals are one shuffle by document. Blank lines are left out of line numbers.
    """
    kind, boxed = dict(pages.dtypes)["document_id"], "words" in pages.columns

    names, kinds = ["k", "text", "line_start", "line_end", "word_start", "word_end", "words"], [pa.int32(), pa.string(), *[pa.int32()] * 5]

    def plain(batch: pa.RecordBatch) -> Iterator[tuple]:
        for at in range(0, batch.num_rows, ROWS_HELD):
            for doc, page, lines in zip(*[c.to_pylist() for c in batch.slice(at, ROWS_HELD).columns], strict=True):
                yield doc, page, [(x, None, None) for x in lines or () if x]

    def placed(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc, page, texts, spans in spanned(batch):
            yield doc, page, [(texts[k], a, b) for k, a, b in spans]

    def made(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [kind, pa.int32(), *kinds], strict=True)], ["document_id", "page_index", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, of = [], 0, batch.column("document_id").type
            for doc, page, spans in (placed if boxed else plain)(batch):
                for k, p in enumerate(passages_of(spans)):
                    rows.append((doc, page, k, *p, len(p[0].split())))
                    held += rows[-1][-1]
                    if held >= WORDS_HELD:
                        yield made(rows, of)
                        rows, held = [], 0
            if rows:
                yield made(rows, of)

    taken = edges(pages) if boxed else pages.select("document_id", "page_index", "lines")
    cut = taken.mapInArrow(run, f"document_id {kind}, page_index int, k int, text string, line_start int, line_end int, word_start int, word_end int, words int")
    ordinal = F.row_number().over(W.partitionBy("document_id").orderBy("page_index", "k")) - 1
    return cut.select("document_id", "page_index", ordinal.alias("ordinal"), "text", "line_start", "line_end", "word_start", "word_end", "words")


def digests(values: DataFrame) -> DataFrame:
    """One passage per document: `label: value` lines in the schema's order (values: document_id, position, label, shown)."""
    line = F.struct("position", F.concat_ws(": ", "label", "shown").alias("line"))
    rows = values.where("shown is not null and shown <> ''").groupBy("document_id").agg(F.sort_array(F.collect_list(line)).alias("l"))
    return rows.select("document_id", F.array_join(F.col("l.line"), "\n").alias("text"))


def embed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("tokens", F.array_distinct(lexical_tokens(F.col("text")))).withColumn("embedding", lexical_vector(lexical_tokens(F.col("text"))))


def _score_pairs(asked: list[tuple[int, list[str], np.ndarray]], top: int | None):
    """Scores of each chunk for each question; with `top`, only what is among the best of a question that the task has seen so far leaves it. ROWS_HELD chunks are held as Python values."""
    matrix = np.stack([e for _, _, e in asked])
    words = [set(t) for _, t, _ in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0)] * len(asked)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_HELD):
                rows = batch.slice(first, ROWS_HELD)
                has = np.flatnonzero(rows.column("embedding").is_valid().to_numpy(zero_copy_only=False))
                if not len(has):
                    continue
                vectors = rows.column("embedding").flatten().to_numpy().reshape(len(has), -1)
                cosines = np.clip(vectors @ matrix.T, 0, 1)
                tokens = [set(t or ()) for t in rows.column("tokens").take(pa.array(has)).to_pylist()]
                of, at, scores = [], [], []
                for q, own in enumerate(words):
                    score = np.minimum(1, cosines[:, q] + np.minimum(MOST_BOOST, BOOST * np.array([len(own & t) for t in tokens])))
                    found = np.arange(len(has))
                    if top is not None:
                        held = np.concatenate([best[q], score])
                        best[q] = held if len(held) <= top else np.partition(held, -top)[-top:]
                        found = found if len(held) <= top else np.flatnonzero(score >= best[q].min())
                    of.append(np.full(len(found), asked[q][0], np.int64))
                    at.append(has[found])
                    scores.append(score[found])
                taken = pa.array(np.concatenate(at))
                if len(taken):
                    own_columns = [rows.column(c).take(taken) for c in ("chunk_id", "document_id", "is_digest")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(of)), *own_columns, pa.array(np.concatenate(scores))], names=["question_id", "chunk_id", "document_id", "is_digest", "score"])

    return run


def search(chunks: DataFrame, questions: DataFrame, *, top: int = TOP, floor: float = FLOOR) -> DataFrame:
    """The best passages of each question, then the digests of their documents.

    chunks: chunk_id string, document_id, is_digest, tokens, embedding (of unit length, or null: no signal). questions: question_id long,
    tokens, embedding; a stated set, taken in blocks of at most QUESTIONS, each of which goes to the tasks as one matrix. A task gives up
    what is among the `top` rows (and ties) of a question that it has seen so far, and holds no more passages as Python values for a larger batch.
    """
    n = -(-questions.count() // QUESTIONS)
    if n > 1:
        blocks = [questions.where(F.pmod(F.xxhash64("question_id"), F.lit(2 * n)) == k) for k in range(2 * n)]
        return reduce(DataFrame.unionByName, [search(chunks, b, top=top, floor=floor) for b in blocks])
    asked = [(r.question_id, r.tokens, np.array(r.embedding)) for r in questions.where("embedding is not null").collect()]
    rows = chunks.select("chunk_id", "document_id", "is_digest", "tokens", "embedding")
    schema = f"question_id long, chunk_id string, document_id {dict(chunks.dtypes)['document_id']}, is_digest boolean, score double"
    if not asked:
        return chunks.sparkSession.createDataFrame([], schema)
    place = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id"))
    hits = rows.mapInArrow(_score_pairs(asked, top), schema).withColumn("place", place).where(F.col("place") <= top).where(F.col("score") >= floor).drop("place")
    hits = hits.persist()  # at most `top` rows a question, used four times
    digest = rows.where("is_digest").join(hits.select("document_id").distinct(), "document_id", "left_semi").select(*rows.columns).mapInArrow(_score_pairs(asked, None), schema)
    more = digest.join(hits.select("question_id", "document_id").distinct(), ["question_id", "document_id"], "left_semi")
    more = more.join(hits.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti")
    return hits.unionByName(more.select(*hits.columns))


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of the vectors of each length: where they are, and their matrix; null ones, ones with a null and empty ones are left out."""
    held = column.combine_chunks()
    lengths = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = held.flatten()
    values, absent, starts = flat.to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
    out = {}
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        cells = starts[at][:, None] + np.arange(n)
        whole = ~absent[cells].any(axis=1)
        if whole.any():
            out[int(n)] = at[whole], values[cells[whole]].astype(float)
    return out


def _in_turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first to the last component as functions.vectors.dot does, so that equal vectors have equal scores."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        total += x * y
    return total


def _few(query: np.ndarray, rank: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each query, ties by rank."""
    order = np.lexsort((rank, -score, query))
    query, rank, score = query[order], rank[order], score[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], rank[kept], score[kept]


def _best(queries: np.ndarray, vectors: np.ndarray, ranks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, rank, cosine) of the k best of each query. A product of matrices says which pairs can be among them, with some slack; those are scored exactly."""
    with np.errstate(all="ignore"):
        own, other = (np.sqrt(_in_turn(x, x)) for x in (queries, vectors))
        sound = [(n > 1e-100) & (n < 1e100) for n in (own, other)]
        unit = [np.where(ok[:, None], x / n[:, None], 0.0) for x, n, ok in zip((queries, vectors), (own, other), sound, strict=True)]
        held = (np.zeros(0, np.int64), np.zeros(0, ranks.dtype), np.zeros(0))
        floor = np.full(len(queries), -1.0)
        for first in range(0, len(vectors), 2048):
            part = slice(first, first + 2048)
            for at in range(0, len(queries), 512):
                asked = slice(at, at + 512)
                near = np.clip(unit[0][asked] @ unit[1][part].T, 0, 1)
                near[:, ~sound[1][part]] = -1
                least = floor[asked]
                if near.shape[1] > k:
                    least = np.maximum(least, np.partition(near, -k, axis=1)[:, -k])
                # what has no sound norm is scored always
                q, v = np.nonzero((near >= least[:, None] - 1e-9) | ~sound[1][part] | ~sound[0][asked][:, None])
                for some in range(0, len(q), 1 << 16):
                    i, j = q[some : some + (1 << 16)] + at, v[some : some + (1 << 16)] + first
                    norms, score = own[i] * other[j], _in_turn(queries[i], vectors[j])
                    score = np.where(norms == 0, 0.0, score / norms)
                    score = np.where(np.isnan(score), 1.0, np.clip(score, 0.0, 1.0))  # as least and greatest of Spark have it
                    held = _few(*(np.concatenate(x) for x in zip(held, (i, ranks[j], score), strict=True)), k)
            full = np.bincount(held[0], minlength=len(queries)) >= k
            floor[full] = held[2][np.searchsorted(held[0], np.flatnonzero(full), "right") - 1]
    return held


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUESTIONS, part: int = VECTORS) -> DataFrame:
    """The k vectors of highest cosine for each query (query_id, query): id and score, ties by id.

    A stated query set against all vectors: blocks of about `block` queries meet parts of about `part` vectors, each pair in one group, and
    k of a query leave it. So what a task holds doesn't grow with either, while the products do with both. An empty set gives no rows.
    """
    n, m = (max(1, -(-df.count() // size)) for df, size in ((queries, block), (vectors, part)))
    spread = lambda df, key, vector, own, many, other, times: df.select(key, F.col(vector).cast("array<double>").alias(vector), F.pmod(F.xxhash64(key), F.lit(many)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))).alias(other))
    asked = spread(queries, "query_id", "query", "of", n, "among", m)
    known = spread(vectors, "vec_id", "embedding", "among", m, "of", n)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("vec_id").combine_chunks()
        order = ids.to_numpy(zero_copy_only=False).argsort(kind="stable")
        ranks = np.empty(len(ids), np.int64)
        ranks[order] = np.arange(len(ids))
        found = _by_length(right.column("embedding"))
        rest, out = np.ones(left.num_rows, bool), []
        for length, (at, matrix) in _by_length(left.column("query")).items():
            rest[at] = False
            with_, of = found.get(length, (np.zeros(0, np.int64), np.zeros((0, length))))
            q, r, score = _best(matrix, of, ranks[with_], k)
            others = np.sort(np.delete(ranks, with_))[:k]  # of another length, or none: 0
            q, r, score = _few(np.concatenate([q, np.repeat(np.arange(len(at)), len(others))]), np.concatenate([r, np.tile(others, len(at))]), np.concatenate([score, np.zeros(len(at) * len(others))]), k)
            out.append((at[q], r, score))
        none = np.flatnonzero(rest)
        few = np.arange(min(k, len(ids)))
        out.append((np.repeat(none, len(few)), np.tile(few, len(none)), np.zeros(len(none) * len(few))))
        q, r, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": left.column("query_id").take(pa.array(q)), "vec_id": ids.take(pa.array(order[r])), "score": pa.array(score)})

    pairs = asked.groupBy("of", "among").cogroup(known.groupBy("of", "among"))
    scored = pairs.applyInArrow(run, f"query_id {dict(queries.dtypes)['query_id']}, vec_id {dict(vectors.dtypes)['vec_id']}, score double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("place", place).where(F.col("place") <= k)
