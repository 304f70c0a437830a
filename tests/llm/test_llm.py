from __future__ import annotations

import collections
import hashlib
import random
import re
import string
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from tabulon.llm import decontam, fingerprint, license_scan, line_dedup, packing, quality, token_files, toxicity, url_filter
from tabulon.llm.components import components
from tabulon.llm.encode import tokenizer_path
from tabulon.llm.jaccard_join import jaccard_components
from tabulon.llm.regions import Region
from tabulon.llm.store import Scratch

RND = random.Random(5)
VOCABULARY = ["".join(RND.choice(string.ascii_lowercase) for _ in range(RND.randint(2, 8))) for _ in range(3000)]


def prose(n, rnd=RND):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def near(text, edits, rnd=RND):
    words = text.split(" ")
    for _ in range(edits):
        words[rnd.randrange(len(words))] = rnd.choice(VOCABULARY)
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, a hot source, nulls, empty and short texts, repeated rows, and columns with clashing names."""
    base = [prose(RND.randint(8, 300)) for _ in range(40)]
    rows = [(i, t, f"s{i % 12}") for i, t in enumerate(base)]
    hot = prose(200)
    rows += [(100 + i, near(hot, RND.randint(0, 5)), "s0") for i in range(60)]
    rows += [(200 + i, base[3], "s1") for i in range(20)]
    rows += [(300, None, None), (301, "", "s1"), (302, "  \n ", "s2"), (303, "one", "s3"), (304, "one", "s3"), (305, "a b c d", "s4"), (None, base[1], "s5"), (2, base[2], "s2"), (306, prose(4000), "s6")]
    rows += [(400 + i, "Same line everywhere here.\n" + prose(20) + "\n" + f"only {i}", f"s{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(1) for c in ("x", "n", "h", "print", "gone", "key", "bucket")})


def test_jaccard_is_exact(corpus):
    rows = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    sets, root = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
        root[i] = i

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for bound in (2_000_000, 400):
        got = jaccard_components(corpus, region_tokens=bound).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.n_shingles == len(sets[r.doc_id])
            assert r.component_id == (None if r.doc_id is None else find(r.doc_id)), r


def test_jaccard_links_at_the_edge_of_a_ring(spark):
    """x is at exactly 80 % of the pivot and of y, y at 60 % of the pivot: all are one component, in cut regions too."""
    rnd, rows = random.Random(4), []
    for k in range(40):
        words = [f"{w}{k}" for w in rnd.sample(VOCABULARY, 10)]
        for i, gone in enumerate(rnd.sample([(), (0, 1), (2, 3)], 3)):
            rows.append((3 * k + i, " ".join(w for j, w in enumerate(words) if j not in gone)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bound in (2_000_000, 20):
        got = jaccard_components(docs, size=1, region_tokens=bound).collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(i, i // 3 * 3) for i, _ in rows}


def links_by_hand(sets, percent=80):
    """The smallest index that links reach, from all pairs."""
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


def walked(rng, n, size, most):
    """Sets that drift: each is the one before with up to `most` shingles changed, so all distances occur."""
    now, out = np.unique(rng.integers(0, 2**60, size)), []
    for _ in range(n):
        now = now.copy()
        at = rng.choice(len(now), rng.integers(0, most + 1), replace=False)
        now[at] = rng.integers(0, 2**60, len(at))
        now = np.unique(now)
        out.append(now)
    return out


def copied(rng, n, size, most):
    """Edited copies of one set."""
    base, out = np.unique(rng.integers(0, 2**60, size)), []
    for _ in range(n):
        one = base.copy()
        at = rng.choice(size, rng.integers(0, most + 1), replace=False)
        one[at] = rng.integers(0, 2**60, len(at))
        out.append(np.unique(one))
    return out


def test_regions_are_exact():
    """Parts are split by pivots and windows at middling distances; hot shingles, copies and small sets agree with all pairs."""
    rng, splits = np.random.default_rng(1), 0
    for turn in range(120):
        kind, percent = turn % 5, (80, 80, 60, 90)[turn % 4]
        if kind == 0:
            sets = copied(rng, int(rng.integers(3, 150)), 60, int(rng.integers(1, 40)))
        elif kind == 1:
            sets = [np.unique(np.append(rng.integers(0, 2**60, rng.integers(1, 12)), 7)) for _ in range(120)]
        elif kind == 2:
            sets = walked(rng, 120, 50, 8)
        elif kind == 3:
            sets = [np.unique(rng.integers(0, 40, rng.integers(3, 30))) for _ in range(100)]
        else:
            base = np.unique(rng.integers(0, 2**60, 100))
            sets = [np.unique(np.concatenate([base[: rng.integers(70, 101)], rng.integers(0, 2**60, rng.integers(0, 30))])) for _ in range(rng.integers(3, 12))]
        region = Region(list(range(len(sets))), sets, percent)
        root = list(range(len(sets)))
        for a, b in region.run():
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
        assert root == links_by_hand([set(s.tolist()) for s in sets], percent)
        splits += region.splits
    assert splits > 100


def test_large_region_of_near_copies_takes_seconds():
    region = Region(list(range(8000)), copied(np.random.default_rng(2), 8000, 250, 40), 80)
    began = time.time()
    region.run()
    assert time.time() - began < 20


def test_jaccard_splits_large_regions_on_the_cluster(spark):
    """Groups that drift, copies and short texts with a hot shingle, with regions cut far below their sizes."""
    rnd, rows = random.Random(3), []
    for _ in range(2):
        text = prose(60, rnd)
        for _ in range(50):
            text = near(text, rnd.randint(0, 2), rnd)
            rows.append(text)
    base, hot = prose(80, rnd), prose(5, rnd)
    rows += [near(base, rnd.randint(0, 6), rnd) for _ in range(100)] + [f"{hot} {prose(rnd.randint(1, 12), rnd)}" for _ in range(100)]
    rnd.shuffle(rows)
    words = [t.split(" ") for t in rows]
    want = links_by_hand([{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in words])
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for bound in (5000, 300):
        got = {r.doc_id: r.component_id for r in jaccard_components(docs, region_tokens=bound).collect()}
        assert [got[i] for i in range(len(rows))] == want


def test_empty_tables(spark, corpus):
    none = corpus.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert jaccard_components(none).count() == 0
    assert line_dedup.drop_site_lines(none).count() == 0
    assert fingerprint.fingerprint_documents(none).count() == 0
    assert packing.pack_documents(none, tokenizer=tokenizer_path("word_bpe_49k.json")).count() == 0
    assert license_scan.scan_licenses(none).count() == 0
    assert decontam.find_leaks(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert quality.score_quality(none, labels).count() == 0 and toxicity.score_toxicity(none, labels).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), labels).count() == 0
    uri = Scratch(spark, "none").path
    assert token_files.read_token_files(spark, uri, token_files.write_token_files(none, uri, tokenizer=tokenizer_path("byte_bpe_50k.json"))).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long")
    got = {r.v: r.c for r in components(links, Scratch(spark, "chain")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_token_files(spark, corpus):
    from tokenizers import Tokenizer

    uri = Scratch(spark, "files").path
    got = token_files.read_token_files(spark, uri, token_files.write_token_files(corpus, uri, tokenizer=tokenizer_path("byte_bpe_50k.json"), shards=3)).orderBy("start").collect()
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy("doc_id", "h", "text").collect()]
    start = 0
    for r, (i, text) in zip(got, rows, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    fs, folder = pafs.FileSystem.from_uri(uri)
    shard = token_files.Shard(fs, f"{folder}/part-1")
    k = int(shard.keys[len(shard.keys) // 2])
    record = int(shard.find(np.array([k]))[0])
    text = dict(rows)[k]
    assert shard.ids(record).tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 2]
    assert shard.find(np.array([987654321]))[0] == -1


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**62, 5000).astype(np.uint64))
    table = token_files.PerfectHash.build(keys)
    assert sorted(table.slots(keys)) == list(range(len(keys)))


def test_packing(corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    path = tokenizer_path("word_bpe_49k.json")
    want = collections.Counter()
    for r in corpus.collect():
        want[r.doc_id, tuple([*t.encode(r.text or "", add_special_tokens=False).ids, 2])] += 1
    by_length = {(d, len(ids)): ids for d, ids in want}
    for n in (1, 3, 40):
        got = packing.pack_documents(corpus, tokenizer=path, partitions=n).toPandas()
        found = collections.Counter()
        for r in got.itertuples():
            d = None if np.isnan(r.doc_id) else int(r.doc_id)
            ids = by_length[d, r.doc_tokens]
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
            found.update((d, r.doc_tokens, k) for k in range(r.start, r.start + r.length))
        assert found == collections.Counter({(d, len(ids), k): c for (d, ids), c in want.items() for k in range(len(ids))})
        for _, s in got.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]]
            total = int(s.length.sum())
            assert total & (total - 1) == 0 and total <= 4096


def test_hilbert_neighbours():
    grid = np.array([(a, b) for a in range(8) for b in range(8)])
    order = grid[np.argsort(packing.hilbert(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_fingerprints(corpus):
    rows = sorted(((r.doc_id, r.text or "") for r in corpus.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = fingerprint.fingerprint_documents(corpus).collect()
    want = collections.Counter()
    for k, (i, text) in enumerate(rows):
        n, after = len(text) // 4, rows[(k + 1) % len(rows)][1]
        want[i, len(text), hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    a, b = fingerprint.vectors(["one line\nother line", "other line\none line"])
    assert (a == b).all()
    whole, part = fingerprint.vectors(["p one x\nq two", "q two"])
    assert (fingerprint.combined(whole, fingerprint.vectors(["p one x"])[0], -1) == part).all()
    many, none = fingerprint.vectors(["\n".join(["same"] * 65536), ""])
    assert (many[: fingerprint.STRONG] != none[: fingerprint.STRONG]).any()


def test_fingerprints_take_edits(spark):
    of = lambda t: fingerprint.to_text(fingerprint.vectors([t])[0])
    assert fingerprint.delete(fingerprint.insert(of("a b\nc d"), "e f"), "c d") == of("e f\na b")
    held = spark.createDataFrame([(1, of("a b")), (2, of("c d")), (None, of("x")), (3, None)], "doc_id long, fingerprint string")
    edits = spark.createDataFrame([(1, "e f"), (1, "g h"), (4, "no"), (None, "no"), (2, None)], "doc_id long, text string")
    more = fingerprint.update_fingerprints(held, edits)
    assert {r.doc_id: r.fingerprint for r in more.collect()} == {1: of("g h\na b\ne f"), 2: of("c d"), None: of("x"), 3: None}
    back = fingerprint.update_fingerprints(more, edits, remove=True)
    assert {r.doc_id: r.fingerprint for r in back.collect()} == {1: of("a b"), 2: of("c d"), None: of("x"), 3: None}


def test_line_dedup(corpus):
    rows = [(r.doc_id, r.text, r.source or "") for r in corpus.select("doc_id", "text", "source").collect()]
    sites, first = collections.defaultdict(set), {}
    key = lambda d, p: (d is not None, d or 0, p)
    for d, t, s in rows:
        for p, line in enumerate(t.split("\n") if t is not None else []):
            line = line.strip(" ")
            if line:
                sites[line].add(s)
                first[line] = min(first.get(line, key(d, p)), key(d, p))
    want = collections.Counter()
    for d, t, _ in rows:
        want[d, "\n".join(x for p, x in enumerate(t.split("\n")) if len(sites[x.strip(" ")]) < 8 or first[x.strip(" ")] == key(d, p)) if t is not None else None] += 1
    got = line_dedup.drop_site_lines(corpus)
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert set(got.columns) == {*corpus.columns, "n_lines", "n_removed"}


def licenses_by_hand(rows, templates, least):
    """Every stretch of every text against every template."""
    words = lambda t: re.sub(r"[^a-z0-9]+", " ", (t or "").lower()).split()
    found = {}
    for d, text in rows:
        w = words(text)
        for name, t in templates:
            own = words(t)
            n = min(5, len(own))
            of = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
            there = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
            best = max((len(of & set(there[max(0, i - len(of)) : i + len(of) + license_scan.WINDOW])) / len(of) for i in range(0, max(1, len(there)))), default=0)
            if best >= least:
                found[d, name] = max(best, found.get((d, name), 0))
    return found


def test_licenses_against_every_stretch(spark):
    rnd, notes = random.Random(6), dict(license_scan.TEXTS)
    templates = [*notes.items(), ("it's \"quoted\"", prose(9, rnd)), ("two words", "grant given"), ("long one", prose(400, rnd))]
    rows = [(1, None), (2, ""), (3, prose(50, rnd)), (None, f"x {notes['mit']} y"), (4, notes["mit"]), (4, notes["mit"]), (5, "All rights are reserved. Released under a MIT license")]
    for n in range(120):
        words = " ".join(re.sub(r"[^A-Za-z0-9]+", " ", rnd.choice(templates)[1]).split()).split(" ")
        if n % 3 == 0:
            words = edited_words(words, 1, rnd) if len(words) > 30 else words
        elif n % 3 == 1 and len(words) > 60:
            words = words[: int(0.9 * len(words))]
        rows.append((100 + n, f"{prose(rnd.randint(0, 40), rnd)} {' '.join(words)} {prose(rnd.randint(0, 40), rnd)}"))
    rows.append((999, " ".join(f"{prose(30, rnd)} {notes['isc']}" for _ in range(300))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("template", "key", "i", "own", "size", "words", "w")})
    found = license_scan.scan_licenses(docs, templates=license_scan.template_table(spark, templates))
    assert dict(found.dtypes)["containment"] == "double"
    got, rows_ = {}, found.collect()
    for r in rows_:
        got[r.doc_id, r.template] = r.containment
    assert len(got) == len(rows_)
    want = licenses_by_hand([r for r in rows if r[0] != 999], templates, license_scan.LEAST) | {(999, "isc"): 1.0}
    missed = set(want) - set(got)
    assert set(got) <= set(want) and len(missed) <= 0.02 * len(want), missed
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert license_scan.scan_licenses(docs, templates=license_scan.template_table(spark, [("none", "")])).count() == 0
    shuffled = license_scan.scan_licenses(docs, templates=license_scan.template_table(spark, templates), broadcast_keys=0)
    assert sorted(map(repr, shuffled.collect())) == sorted(map(repr, rows_))


def test_lookup_by_doc_id(spark, tmp_path):
    from tokenizers import Tokenizer

    rnd, path = random.Random(3), tokenizer_path("byte_bpe_50k.json")
    rows = [(7 * i - 300, prose(rnd.randint(0, 30), rnd)) for i in range(90)] + [(0, "x y"), (None, "no id"), (-300, None), *[(330, f"copy {i}") for i in range(60)]]
    docs, uri = spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/ids"
    shards = token_files.write_token_files(docs, uri, tokenizer=path, shards=5)
    asked = [-300, 0, 1, 7, 330, 330, 323, 10**12, -(2**63), None, *range(-299, 300, 13)]
    keys = spark.createDataFrame([(k, "?") for k in asked], "doc_id long, ids string")
    got = sorted((r.doc_id, tuple(r.ids)) for r in token_files.lookup(keys, uri, shards).collect())
    whole = Tokenizer.from_file(path)
    want = sorted((d, (*whole.encode(t or "", add_special_tokens=False).ids, 2)) for d, t in rows if d is not None and d in asked)
    assert got == want and len({d for d, _ in got}) > 6
    assert token_files.lookup(keys.limit(0), uri, shards).count() == 0 and token_files.lookup(keys, uri, []).count() == 0


def test_licenses_at_the_least_containment(spark):
    rnd = random.Random(8)
    long = {name: re.sub(r"[^A-Za-z0-9]+", " ", t).split() for name, t in license_scan.TEXTS if len(t.split()) > 60}
    rows, want = [], set()
    for name, words in long.items():
        for n in range(40):
            edits = int(0.2 * (len(words) - 4)) // 5  # each spoils five shingles at most
            at = set(rnd.sample(range(len(words)), edits))
            rows.append((len(rows), name, " ".join(f"edit{rnd.randint(0, 999)}" if i in at else w for i, w in enumerate(words))))
            want.add((rows[-1][0], name))
    found = license_scan.scan_licenses(spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string"))
    got = {(r.doc_id, r.template) for r in found.collect()}
    assert len(want & got) >= 0.95 * len(want), (len(want & got), len(want))


def edited_words(words, edits, rnd, even=False):
    """Words with so many substitutions, insertions and deletions, at random places or evenly spread."""
    out = list(words)
    for k in range(edits):
        at = (k + 1) * len(words) // (edits + 1) if even else rnd.randrange(len(out))
        at, kind = min(at, len(out) - 1), 0 if even else rnd.randrange(3)
        if kind == 0:
            out[at] = rnd.choice(VOCABULARY)
        elif kind == 1:
            out.insert(at, rnd.choice(VOCABULARY))
        else:
            del out[at]
    return out


@pytest.mark.parametrize("lengths", [(1, 4), (5, 10), (11, 14), (15, 60)])
def test_decontamination_against_all_pairs(spark, lengths):
    """Every repeat within the rate is found, at the full rate, and nothing that all pairs of documents and items do not have."""
    rnd = random.Random(9)
    items = [(i, prose(rnd.randint(*lengths), rnd)) for i in range(25)]
    rows = []
    for n in range(80):
        words = rnd.choice(items)[1].split(" ")
        rows.append((n, f"{prose(20, rnd)} {' '.join(edited_words(words, int(0.2 * len(words)), rnd, even=n % 2 == 0))} {prose(20, rnd)}"))
    rows += [(100, prose(100, rnd)), (101, None), (102, ""), (None, rows[0][1]), (103, rows[1][1]), (103, rows[1][1]), (104, prose(20000, rnd) + " " + items[0][1] + " " + prose(5000, rnd))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("item_id", "distance", "row__key")})
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = collections.Counter((r.doc_id, r.item_id, r.distance) for r in decontam.find_leaks(docs, bench).collect())
    of = lambda t: np.array([hash(w) for w in (t or "").split(" ") if w], dtype=np.int64)
    want = collections.Counter()
    for d, t in rows:
        region = of(t)
        for i, text in items:
            item = of(text)
            if len(region):
                n = decontam.infix_distance(item, region)[0]
                if n <= int(0.2 * len(item)):
                    want[d, i, n] += 1
    assert got == want


def test_infix_distance():
    rnd = np.random.default_rng(3)
    for _ in range(30):
        item, region = rnd.integers(0, 5, 6), rnd.integers(0, 5, 15)
        d, a, b = decontam.infix_distance(item, region)

        def edit(x, y):
            row = list(range(len(y) + 1))
            for i, p in enumerate(x, 1):
                last, row = row, [i]
                for j, q in enumerate(y, 1):
                    row.append(min(last[j - 1] + (p != q), last[j] + 1, row[j - 1] + 1))
            return row[-1]

        assert d == min(edit(item, region[i:j]) for i in range(16) for j in range(i, 16))
        assert edit(item, region[a:b]) == d


def test_urls(spark):
    urls = [(1, "http://Sub.Example.com/en/77?x"), (2, "https://a.net/de/1"), (3, "http://x.example.net/de/8#y"), (4, "http://b.org/es/"), (5, None), (6, "nothing"), (7, "http://c.com"), (8, "http://notexample.com/en/7")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert got == {1: ("sub.example.com", "/en/77", "example.com/en/7", "allow"), 2: ("a.net", "/de/1", "net/de/", "allow"), 3: ("x.example.net", "/de/8", "example.net/de/8", "block"), 4: ("b.org", "/es/", "org/es/", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("c.com", "", None, "allow"), 8: ("notexample.com", "/en/7", "com/en/", "block")}


def test_wide_and_deep_urls(spark):
    """A bad branch keeps its verdict among many siblings, and below many segments."""
    pages, labels = [], []

    def add(path, bad, n=10):
        for k in range(n):
            i = len(pages)
            pages.append((i, f"http://h.test/{path}/{'abcdefghij'[k]}{k}"))
            if bad is not None:
                labels.append((i, 1 - bad, 0))

    for k in range(40):
        add(f"part{chr(97 + k // 26)}{chr(97 + k % 26)}", 0)
    add("spam", 1)
    for k in range(40):
        add(f"deep/a/b/c/tail{chr(97 + k // 26)}{chr(97 + k % 26)}", 0)
    add("deep/a/b/c/junk", 1)
    for k in range(40):  # names with one label each are one template
        for kind, bad in (("ok", 0), ("casino", 1)):
            add(f"user/name{chr(97 + k // 26)}{chr(97 + k % 26)}/{kind}", bad, 1)
    got = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.verdict == ("block" if re.search("/(spam|junk|casino)/", r.path) else "allow"), r


def test_forward_backward_against_all_labellings():
    rnd = np.random.default_rng(2)
    node, move = rnd.normal(size=4), rnd.normal(size=(2, 2))
    good, pairs = quality.forward_backward(node, move, np.array([0, 4]))
    weight, total, seen = np.zeros(4), 0.0, np.zeros((2, 2))
    for y in np.ndindex(2, 2, 2, 2):
        p = np.exp(node @ np.array(y) + sum(move[y[k], y[k + 1]] for k in range(3)))
        total += p
        weight += p * np.array(y)
        for k in range(3):
            seen[y[k], y[k + 1]] += p
    assert np.allclose(good, weight / total) and np.allclose(pairs, seen / total)


@pytest.mark.parametrize(("name", "truth", "cut"), [("quality", "quality", 0.5), ("toxicity", "toxic", 0.7)])
def test_classifiers_on_held_out_rows(spark, name, truth, cut):
    where = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    scored = (quality.score_quality(docs, labels) if name == "quality" else toxicity.score_toxicity(docs, labels)).join(labels, "doc_id").where(quality.held_out(F.col("doc_id")))
    column = "quality_score" if name == "quality" else "toxicity"
    rows = [(r[column], r[truth]) for r in scored.select(column, truth).collect()]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.9
    assert sum(s >= cut for s in neg) <= 0.02 * len(neg)


def test_classifiers_score_any_rows(spark):
    """Null and repeated ids, repeated rows, clashing columns, very long texts and another text column."""
    where = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    rows = [(None, "a b c"), (None, None), (1, "x y"), (1, "x y"), (2, prose(60000) + "\n" + prose(10)), (3, ""), (4, "\n".join(prose(6) for _ in range(3000)))]
    odd = spark.createDataFrame(rows, "doc_id long, body string").withColumns({c: F.lit("kept") for c in ("text", "label", "half", "key", "features")})
    for score, name, fit in ((quality.score_quality, "quality_score", quality.train), (toxicity.score_toxicity, "toxicity", toxicity.train)):
        model = fit(docs, labels, per_class=100)
        got = score(odd.withColumn(name, F.lit(9)), labels, text_col="body", model=model)
        assert set(got.columns) == {*odd.columns, name}
        found = got.collect()
        assert collections.Counter((r.doc_id, r.body) for r in found) == collections.Counter(rows)
        assert all(0 <= r[name] <= 1 and r.text == "kept" for r in found)
        assert len({r[name] for r in found if r.body == "x y"}) == 1


def test_toxicity_misses_few(spark):
    where = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    rows = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).where("toxic = 1").collect()
    assert len(rows) > 100 and sum(r.toxicity < 0.7 for r in rows) <= 0.12 * len(rows)


def test_stages_of_the_pipeline_take_empty_and_odd_tables(spark):
    import corpus_pipeline as c

    where = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, row__key string, gone__lines int, d__of_lines int"
    rows = [(None, None, None, None, None, "k", 1, 1), (1, prose(80), "en", None, None, None, None, None), (1, "", "en", "s", 0, "k", 1, 1)]
    for given in ([], rows):
        docs = spark.createDataFrame(given, schema)
        for name, stage in c.STAGES[:-1]:
            out = stage(spark, docs, where)
            assert out.columns == docs.columns, name
            assert out.count() <= len(given)
        assert c.packed(spark, docs, where).select("doc_id").distinct().count() == len({r[0] for r in given})


def test_null_texts_are_scored():
    column = pa.array([None, "", "you idiot"], pa.string())
    assert toxicity.features(column, np.zeros(0, np.uint64), np.zeros(0)).shape == (3, toxicity.N_FEATURES)


def test_pipeline(spark):
    import corpus_pipeline

    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, where)
        assert after.columns == docs.columns
        assert 0 < after.count() <= docs.count()
        docs = spark.createDataFrame(after.toPandas(), after.schema)
    pieces = corpus_pipeline.run(spark, where)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_stages_keep_rows_of_null_and_repeated_ids(spark):
    import corpus_pipeline as c

    where, rnd = "/root/testdata/sf0.001", random.Random(8)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = c.good_documents(spark, docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long"))), where).select("doc_id", "text").collect()
    assert collections.Counter(r.text for r in kept if r.doc_id is None) == collections.Counter(r.text for r in kept if r.doc_id is not None)

    make = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    A, B, C, D, E, G, H = (prose(60, rnd) for _ in range(7))
    near_c = C + " more"
    rows = [(None, A), (None, B), (0, near_c), (1, C), (1, D), (2, D), (3, E), (3, E), (None, E), (None, G), (None, G), (5, ""), (5, "")]
    assert found(c.one_of_each_group(spark, make(rows), where)) == collections.Counter([(None, A), (None, B), (0, near_c), (1, D), (3, E), (None, G), (5, ""), (5, "")])

    single = [(None, A), (None, B), (1, C), (1, D)]
    assert found(c.without_site_lines(spark, make(single), where)) == collections.Counter(single)
    item = max((r.text for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()), key=len)
    assert found(c.clean_documents(spark, make([*single, (None, f"{G} {item}"), (1, f"{H} {item}")]), where)) == collections.Counter(single)
    assert found(c.packed(spark, make(single), where).select("doc_id", F.lit("").alias("text"))).keys() == {(None, ""), (1, "")}
