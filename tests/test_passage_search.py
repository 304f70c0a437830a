"""What a task of the search over passages holds doesn't grow with the rows of a batch."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tabulon.functions import vectors
from tabulon.operators import retrieve


def peak(run) -> float:
    """MB of Python and numpy that a run holds at most."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def passages(n: int) -> list[list[str]]:
    rnd = random.Random(n)
    return [[f"word{rnd.randrange(5000)}" for _ in range(75)] for _ in range(n)]


def test_vectors_leave_some_rows_at_a_time():
    texts = passages(3000)
    texts[7] = None
    texts[1200] = []
    words = pa.array(texts, pa.list_(pa.string()))
    made = list(vectors.lexical_vector.func(iter([words, words.slice(0, 0)])))
    assert sum(map(len, made)) == 3000 and max(map(len, made)) <= vectors.ROWS_HELD
    rows = [v for part in made for v in part.to_pylist()]
    assert [k for k, v in enumerate(rows) if v is None] == [7, 1200]
    alone = next(vectors.lexical_vector.func(iter([words.slice(2999, 1)])))
    assert alone.to_pylist() == rows[-1:] and abs(np.linalg.norm(rows[0]) - 1) < 1e-12
    assert peak(lambda: [None for _ in vectors.lexical_vector.func(iter([words]))]) < 15


def test_scores_hold_some_passages_at_a_time_and_lose_none():
    rnd = np.random.default_rng(3)
    texts, n = passages(4000), 4000
    texts[5] = None
    flat = rnd.random((n, vectors.DIMENSIONS)) ** 20
    unit = flat / np.linalg.norm(flat, axis=1)[:, None]
    embedding = pa.array([None if k % 11 == 0 else v for k, v in enumerate(unit)], pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array([f"c{k}" for k in range(n)]), pa.array(range(n)), pa.array([False] * n), pa.array(texts, pa.list_(pa.string())), embedding], ["chunk_id", "document_id", "is_digest", "tokens", "embedding"])
    asked = [(10 + q, texts[q][:20], unit[q + 1]) for q in range(4)]
    for top in (8, None):
        got = {}
        for part in retrieve._score_pairs(asked, top)(iter([batch.slice(0, 1700), batch.slice(1700)])):
            for q, c, s in zip(*[part.column(x).to_pylist() for x in ("question_id", "chunk_id", "score")], strict=True):
                assert got.setdefault(q, {}).setdefault(c, s) == s
        for q, own, vector in asked:
            want = {f"c{k}": min(1.0, min(max(float(unit[k] @ vector), 0.0), 1.0) + min(0.1, 0.02 * len(set(own) & set(texts[k] or ())))) for k in range(n) if k % 11}
            best = sorted(want, key=lambda c: -want[c])[:top]
            assert set(best) <= got[q].keys() and all(abs(got[q][c] - want[c]) < 1e-9 for c in got[q])
            assert top is None or len(got[q]) < 200
    assert peak(lambda: [None for _ in retrieve._score_pairs(asked, 8)(iter([batch]))]) < 20
