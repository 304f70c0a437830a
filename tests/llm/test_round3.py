"""Filter audit, hard negatives and chat formatting against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import chat_format, filter_audit, hard_negatives, url_filter
from tabulon.llm.jaccard_join import jaccard_components
from tabulon.llm.store import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(docs):
    """The letters of each row, straight from the contract. docs: (doc_id, text, lang)."""
    out = []
    for i, text, _ in docs:
        t = text or ""
        w = WORD.findall(t)
        letters = set()
        if len(w) < 100:
            letters.add("A")
        if 100 * len(set(w)) < 80 * len(w):
            letters.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            letters.add("C")
        if re.search(r"[#$%&*|]", t):
            letters.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs):
            letters.add("E")
        out.append(letters)
    return out


def audited(docs, labels):
    """Rows by applying every order to every document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed, rows, shares = fails(docs), {}, {}
    for part in {lang or "" for _, _, lang in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [k for k, d in enumerate(docs) if (d[2] or "") == part]
            gone = []
            for step, x in enumerate(order, 1):
                removed = [k for k in left if x in failed[k]]
                redundant = sum(x in failed[k] for k in gone)
                unique = sum(failed[k] == {x} for k, d in enumerate(docs) if (d[2] or "") == part)
                left = [k for k in left if x not in failed[k]]
                gone += removed
                shares[part, x] = shares.get((part, x), 0) + len(removed)
                rows[part, order, step] = [len(left), len(removed), redundant, unique, sum(docs[k][0] in good for k in removed), sum(docs[k][0] in toxic for k in removed)]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_every_order_applied(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    pool = [" ".join(rnd.choice(words[: rnd.choice([20, 400])]) for _ in range(rnd.choice([0, 3, 99, 100, 150]))) for _ in range(20)]
    pool += [pool[4].upper(), pool[5] + " #", "A" * 10, "ÀÉ" * 30, "", " \x1c\x0b\n", "a\x0bb c", "x " * 30000, None]
    docs = [(i, rnd.choice(pool), rnd.choice(["en", "de", None, ""])) for i in rnd.sample(range(-100, 900), 120)]
    docs += [(None, pool[0], "en"), (None, pool[0], "en"), (docs[0][0], docs[0][1], docs[0][2]), (docs[1][0], "other text", "xx"), (9999, docs[2][1], "only a copy")]
    labels = [(d[0], rnd.randint(0, 1), rnd.randint(0, 1)) for d in docs[:60] if d[0] is not None] + [(docs[0][0], None, 1), (None, 1, 1), (5555, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit(7) for c in ("part", "mask", "n", "digest", "words", "good")})
    got = filter_audit.audit_filters(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = audited(docs, labels)
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in NAMES) for r in got} == want and len(got) == len(want)


def test_audit_of_nothing_and_of_other_filters(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(none, labels).collect() == []
    docs = spark.createDataFrame([(1, "long enough", "en"), (2, "x", "en"), (3, "x", "en")], "id long, body string, lang string")
    got = filter_audit.audit_filters(docs, labels, filters={"S": lambda t, w: F.length(t) < 3}, copies="C", id_col="id", text_col="body").collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got} == {("SC", 1): (1, 2, 0, 1, 3), ("SC", 2): (1, 0, 1, 0, 1), ("CS", 1): (2, 1, 0, 0, 1), ("CS", 2): (1, 1, 1, 1, 3)}
    with pytest.raises(ValueError):
        filter_audit.audit_filters(docs, labels, copies="A")


def mined(rows, scale=256, k=5, n=5, percent=80):
    """(anchor, positive, rank, negative, scores) of rows (id, vector, label), by all pairs in whole numbers."""
    good = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    good = [r for r in good if sum(x * x for x in r[1]) < 1 << 62]
    inner = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for p, (i, v, y) in enumerate(good):
        if i % 100:
            continue
        same = sorted((-inner(v, w), j) for q, (j, w, z) in enumerate(good) if z == y and p != q)[:k]
        other = sorted((-inner(v, w), j) for j, w, z in good if z != y)
        for s, j in same:
            fit = [(t, m) for t, m in other if percent * -s <= 100 * -t <= 100 * -s][:n]
            out += [(i, j, r, m, -s, -t) for r, (t, m) in enumerate(fit, 1)]
    return sorted(out)


def vectors(rnd, n, d=8, copies=40):
    """Clusters, a vector with many copies, ties, zeros and rows that take no part."""
    centres = [rnd.normal(size=d) for _ in range(6)]
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 6] + 0.3 * rnd.normal(size=d)], int(rnd.integers(0, 3))) for i in range(n)]
    rows += [(1000 + i, rows[0][1], int(i % 2)) for i in range(copies)]
    rows += [(2000 + i, [0.0] * d, 1) for i in range(3)]
    rows += [(3000, None, 1), (3100, [None] * d, 1), (3200, [float("nan")] * d, 1), (3300, [float("inf")] * d, 1), (None, rows[1][1], 1), (3400, rows[2][1], None), (3500, [1e30] * d, 1)]
    return rows + [(3600, rows[3][1][:3], 0), (3700, [], 1), rows[100], rows[200 % n]]


@pytest.mark.parametrize("pivots, group, per_task", [(None, 1024, 8192), (1, 2, 50), (40, 2, 16), (7, 1, 1000)])
def test_negatives_are_exact(spark, pivots, group, per_task):
    rows = vectors(np.random.default_rng(4), 330)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("rid", "id", "v", "cell", "d", "home", "slot", "score")})
    got = hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 100 == 0, pivots=pivots, group=group, rows_per_task=per_task)
    want = mined(rows)
    assert len(want) > 100
    assert sorted(map(tuple, got.collect())) == want


def test_negatives_of_long_vectors_are_exact_beyond_doubles(spark):
    rnd = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rnd.integers(-2_000_000, 2_000_000, size=6)], i // 10 % 2) for i in range(0, 3000, 10)]
    got = hard_negatives.mine_hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 100 == 0, group=4, rows_per_task=40)
    want = mined(rows)
    assert want and sorted(map(tuple, got.collect())) == want


def test_bounds_leave_out_most_cells_of_clustered_rows(spark):
    """What the windows let through holds every row in range, and far fewer rows than all."""
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(30, 16)) * 1000
    x = np.floor(centres[rnd.integers(0, 30, 3000)] + rnd.normal(size=(3000, 16)) * 20)
    space = hard_negatives.Voronoi(centres.round(), float(np.sqrt((x * x).sum(1).max())))
    cell, d = space.cells(x)
    space.lo = np.array([d[cell == c].min() if (cell == c).any() else 0.0 for c in range(30)])
    space.hi = np.array([d[cell == c].max() if (cell == c).any() else -np.inf for c in range(30)])
    queries, inner = x[:50], x[:50] @ x.T
    high = np.sort(inner, axis=1)[:, -2]
    low = np.floor(0.8 * high)
    first, last = space.windows(queries, low, high)
    through = (first[:, cell] <= d) & (d <= last[:, cell])
    assert through[(inner >= low[:, None]) & (inner <= high[:, None])].all()
    assert through.mean() < 0.3


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine_hard_negatives(none, F.col("vec_id") % 100 == 0).collect() == []
    few = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine_hard_negatives(few, F.col("vec_id") % 100 == 0).collect() == []
    assert hard_negatives.mine_hard_negatives(few, F.col("vec_id") > 5).collect() == []


def test_formatted_chats_read_back(spark):
    rnd = random.Random(3)
    marks = ["[INST]", "[/INST]", "[OUT]", "</s>", "<s>", "[ROLE]", "[/ROLE]", "[TEXT]", "[NEXT]", "\\", "\n", " ", "[", "]", "/", "ö😀", "a", "[INST", "\x00", "$1", "\\Q", "\\E", ""]
    text = lambda: "".join(rnd.choice(marks) for _ in range(rnd.randint(0, 12)))
    rows = [(c, t, rnd.choice(["user", "assistant", "assistant", "system", "tool [TEXT] x", "", None]), rnd.choice([text(), text(), None])) for c in range(60) for t in range(rnd.randint(1, 9))]
    rows += [(100, t, "assistant", f" {t} ") for t in range(900)] + [(101, None, "user", "late"), (101, 1, "user", "b"), (101, 1, "user", "a"), (101, 1, "assistant", "z"), (101, 1, "user", "a"), (None, 0, "user", "q"), (None, 1, "assistant", "r"), (102, 0, "user", "x " * 200_000), (102, 1, "assistant", "</s>" * 50_000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("turns", "pieces", "loss", "body")})
    chats = chat_format.format_chats(df)
    got = {r.conv_id: r for r in chats.select("*", chat_format.turns_in(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("said")).collect()}
    assert got.keys() == {r[0] for r in rows}
    control = re.compile(chat_format.CONTROL)
    for c, r in got.items():
        want = [(b or "", t or "") for _, b, t in sorted(((-1 if t is None else t, b or "", x or "") for k, t, b, x in rows if k == c))]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.said == "".join(t for b, t in want if b == "assistant")
        raw = r.formatted.encode()
        spans = [raw[s.start : s.start + s.length].decode() for s in r.loss_spans]
        assert spans == [control.sub(lambda m: "\\" + m[0], t) for b, t in want if b == "assistant"]
        # what is left without escaped strings is the template's: a block for each run of one role
        marks_left = re.findall(chat_format.CONTROL, re.sub(r"\\(?:%s)" % chat_format.CONTROL, "", r.formatted))
        runs = [k for k, _ in itertools.groupby(b for b, _ in want)]
        assert sum(m in ("[INST]", "[OUT]", "[ROLE]") for m in marks_left) == len(runs)
        assert marks_left.count("[NEXT]") == len(want) - len(runs)
    digest = {r.conv_id: r for r in chat_format.digests(chats).collect()}
    assert digest[101].turns_sha256 == hashlib.sha256(b"user\nlate\nassistant\nz\nuser\na\nuser\na\nuser\nb\n").hexdigest()
    assert digest[101].loss_chars == 1 and digest[101].formatted_chars == len(got[101].formatted)


def test_no_python_runs_in_native_operators(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    chats = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    masks = filter_audit.failure_masks(docs, Scratch(spark, "t"))
    for df in (chat_format.digests(chat_format.format_chats(chats)), filter_audit.orders_of(filter_audit.histogram(masks, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")), "ABCDE")):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_conversations_of_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.format_chats(none)).collect() == []


def test_no_region_is_without_a_pivot(spark):
    """Documents of which a rule by the hash alone would choose none as pivot, and near copies in one region of any size."""
    rnd = random.Random(6)
    ids = [r.id for r in spark.range(3000).where(F.pmod(F.xxhash64("id", F.lit(0)), F.lit(4)) != 0).limit(64).collect()]
    words = [f"w{rnd.randrange(10**6)}" for _ in range(61)]
    rows = [(i, " ".join([*words[:30], f"x{i}", *words[31:]])) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bound in (2_000_000, 1000, 100, 10):
        assert {r.component_id for r in jaccard_components(docs, region_tokens=bound).collect()} == {min(ids)}, bound


def test_levels_of_urls_follow_branchings(spark):
    deep = "/".join(f"s{'abcdefghij'[k % 10]}" for k in range(1000))
    pages = [(1, f"http://h.com/{deep}/good/x"), (2, f"http://h.com/{deep}/bad/x"), (3, f"http://h.com/{deep}/bad/y"), (4, "http://h.com/a/b/c"), (5, "http://h.com/a/b/c/d"), (5, "http://h.com/a/b/c/d"), (6, None)]
    pages += [(10 + k, f"http://h.com/{deep}/{'bad' if k % 2 else 'good'}/{'abcdefghijklmnopqrstuvwxyz'[k % 26]}q") for k in range(52)]
    labels = [(10 + k, k % 2 ^ 1, 0) for k in range(52)]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "rest", "run", "g1", "shapes")})
    began = time.time()
    got = url_filter.filter_urls(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert time.time() - began < 60 and len(got) == len(pages)
    for r in got:
        if "/good/" in r.path or "/bad/" in r.path:
            assert r.verdict == ("block" if "/bad/" in r.path else "allow"), r
