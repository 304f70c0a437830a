"""N-gram Jaccard join: exact components of documents whose shingle sets are near, by regions around pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bytewords
from .components import components
from .regions import Region
from .store import Scratch

PERCENT = 80
#: A hash that makes up more than one in FREQUENT of a sample (one document in SAMPLE) is dealt to several tasks.
FREQUENT, SAMPLE = 4096, 16
#: Pivots of a region that is split on the cluster, about; levels of splits.
PIVOTS, LEVELS = 16, 4
#: Rows that reach Python at once; texts can be long.
BATCH = 1000


def _need(n: int, percent: int) -> int:
    """Shingles that a document of n shares at least with each partner."""
    return -(-percent * n // 100)


def _spare(n: int) -> int:
    return max(1, n // 10)


def _prefix(n: int, percent: int) -> int:
    """So many of the least hashes of a document and of a partner have at least min(spare, spare of the partner) in common."""
    return min(n, n - _need(n, percent) + _spare(n))


def _shared(n: int, percent: int) -> int:
    """Lower bound of that common number, from this document's size alone: a partner has _need(n) shingles at least."""
    return _spare(_need(n, percent))


def _signatures(percent: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, counts, least, shared = [], [], [], []
            for s in bytewords.shingle_sets(batch.column("text"), size):
                n = len(s)
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                counts.append(n)
                least.append(s[: _prefix(n, percent)])
                shared.append(_shared(n, percent) if n else 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.binary()), pa.array(counts, pa.int64()), pa.array(shared, pa.int64()), bytewords.list_array(least, pa.int64())], names=["doc_id", "print", "n", "shared", "least"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, rows = batch.column("print").to_pylist(), []
            sets = list(bytewords.shingle_sets(batch.column("text"), size))
            rows = [i for i, s in enumerate(sets) if xxhash.xxh3_128_digest(s.tobytes()) == same[i]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), bytewords.list_array([sets[i] for i in rows], pa.int64())], names=["x", "tokens"])

    return run


def _join_regions(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []
        found: list[tuple[int, int]] = []

        def close() -> None:
            if len(ids) == 2:
                common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
                if 100 * common >= percent * (len(sets[0]) + len(sets[1]) - common):
                    found.append((ids[0], ids[1]))
            elif len(ids) > 2:
                found.extend(Region(ids, sets, percent).run())

        for batch in batches:
            keys, xs = batch.column("region").to_pylist(), batch.column("x").to_pylist()
            tokens = batch.column("tokens")
            for i, k in enumerate(keys):
                if k != key:
                    close()
                    key, ids, sets = k, [], []
                if not ids or xs[i] not in ids[-1:]:
                    ids.append(xs[i])
                    sets.append(tokens[i].values.to_numpy(zero_copy_only=False))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])
                found.clear()
        close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return run


def _salted(rows: DataFrame, hot: DataFrame, parts: int = 64) -> DataFrame:
    """`rows` with `often`, the estimated count of a hot hash, and `salt`, which deals its rows to so many groups; null and 0 for other hashes."""
    rows = rows.join(F.broadcast(hot), "h", "left")
    return rows.withColumn("salt", F.when(F.col("often").isNotNull(), F.pmod(F.xxhash64("x"), F.lit(parts))).otherwise(F.lit(0)))


def _hot(signed: DataFrame) -> DataFrame:
    """Hashes that make up more than one in FREQUENT of a sample of all hashes, so fewer than FREQUENT rows: h, often.

    The sample only says which hashes are dealt to several tasks and go last among the shared ones; results don't depend on it.
    """
    sample = signed.where(f"n > 0 and pmod(xxhash64(doc_id, 'sample'), {SAMPLE}) = 0").select(F.explode("least").alias("h"))
    counts = sample.groupBy("h").agg(F.count("*").alias("often")).where("often > 1")
    total = sample.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).where(F.col("often") * FREQUENT > F.col("total")).select("h", (F.col("often") * SAMPLE).alias("often"))  # one row


def _regions_of_keys(cells: DataFrame, scratch: Scratch, name: str, *also: str) -> DataFrame:
    """(x, h) -> (p, x): of the documents that hold a hash, the one of least hash is the pivot. Its region are all that share a hash of which it is the pivot.

    Pivots are written, so both sides of the join are plain shuffles and one of many rows is split.
    """
    first = F.min(F.struct(F.xxhash64("x").alias("o"), F.col("x").alias("p"))).alias("m")
    pivots = cells.groupBy(*also, "h").agg(first, F.count("*").alias("k")).where("k > 1").select(*also, "h", F.col("m.p").alias("p"))
    return cells.join(scratch.keep(pivots, name), [*also, "h"]).select(*also, "p", "x").distinct()


def _by_pivots(big: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, level: int) -> tuple[DataFrame, DataFrame]:
    """Links with pivots, and the regions (region, x) of the pivots' cells and windows.

    big: (region, x, k, blocks). The PIVOTS documents of each region with the least hashes are its pivots, so every region has one; they go to each
    block of the region, so no task holds more than a block. A document goes to the cell of its nearest pivot, and as boundary to every later one whose
    window it is in. Those within the radius of their pivot are one component, so of them only those stay that another member of the
    region, farther from the pivot, may reach. A region that its windows would make half as large again stays whole.
    """
    radius = 1 - percent / 100
    rows = big.join(sets, "x").withColumn("block", F.pmod(F.xxhash64("x"), "blocks").cast("int"))
    rank = F.row_number().over(W.partitionBy("region").orderBy(F.xxhash64("x", F.lit(level)), "x"))  # a limit per region, taken before the shuffle
    chosen = scratch.keep(big.select("region", "x", "blocks", rank.alias("r")).where(F.col("r") <= PIVOTS).drop("r"), f"chosen-{level}")
    pivots = chosen.join(sets, "x").select("region", F.col("x").alias("p"), F.col("tokens").alias("pivot_tokens"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    common = F.size(F.array_intersect("tokens", "pivot_tokens"))
    met = rows.join(pivots, ["region", "block"]).select("region", "x", "p", common.alias("o"), (F.size("tokens") + F.size("pivot_tokens") - common).alias("u"))
    met = met.select("region", "x", "p", (1 - F.col("o") / F.col("u")).alias("d"), F.expr(f"100 * o >= {percent} * u").alias("near"))
    met = scratch.keep(met, f"distances-{level}")
    links = met.where("near and p <> x").select(F.col("p").alias("a"), F.col("x").alias("b"))
    nearest = met.groupBy("region", "x").agg(F.min(F.struct("d", "p")).alias("m"), F.collect_list(F.struct("p", "d", "near")).alias("all"))
    nearest = nearest.select("region", "x", F.col("m.p").alias("own"), F.col("m.d").alias("least"), F.explode("all").alias("to")).select("region", "x", "own", "least", "to.*")
    mine = nearest.where("p = own")
    reach = mine.groupBy("region", "p").agg(F.max("d").alias("reach"))
    slack = 1e-9
    inside = nearest.join(reach, ["region", "p"]).where(f"p = own or (own < p and d <= least + {2 * radius + slack} and d <= reach + {radius + slack})")
    inside = scratch.keep(inside.select("region", F.xxhash64("region", "p").alias("cell"), "x", "d", "near"), f"cells-{level}")
    outer = inside.where("not near").groupBy("cell").agg(F.min("d").alias("outer"))
    cells = scratch.keep(inside.join(outer, "cell").where(f"not near or d >= outer - {radius + slack}").select("region", "cell", "x"), f"open-{level}")
    grown = cells.groupBy("region").agg(F.count("*").alias("now")).join(big.select("region", "k").distinct(), "region").where("now > 1.5 * k").select("region")
    grown = scratch.keep(grown, f"grown-{level}")
    whole = big.join(grown, "region", "left_semi").select("region", "x")
    return links, cells.join(grown, "region", "left_anti").select(F.col("cell").alias("region"), "x").unionByName(whole)


def _by_prefix(big: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, level: int) -> DataFrame:
    """The regions of documents that share one of their rarest shingles, counted within the region: n - need + 1 of n, as near ones do."""
    rows = big.join(sets, "x").select("region", "x", F.size("tokens").alias("n"), F.explode("tokens").alias("h"))
    counts = scratch.keep(rows.groupBy("region", "h").agg(F.count("*").alias("df")).where("df > 1"), f"counts-{level}")
    held = rows.join(counts, ["region", "h"]).groupBy("region", "x", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("met"))
    # what no other document has comes first in the order and isn't in the list
    prefix = F.expr(f"size(met) - cast(ceil({percent} * n / 100.0) as int) + 1")
    keys = held.withColumn("prefix", prefix).where("prefix > 0").select("region", "x", F.explode(F.expr("transform(slice(met, 1, prefix), m -> m.h)")).alias("h"))
    regions = _regions_of_keys(keys, scratch, f"pivots-{level}", "region")
    return regions.select(F.xxhash64("region", "p").alias("region"), "x")


def _bounded_regions(regions: DataFrame, sets: DataFrame, percent: int, bound: int, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """Regions (region, x) as regions of at most `bound` shingles or so, and links found on the way.

    Regions beyond the bound are split in turn by pivots with windows and by the rarest shingles within them, each level a pass over
    them alone. What LEVELS of that don't bring below the bound is cut into blocks, and each pair of blocks is a region.
    """
    sizes, done, links = sets.select("x", F.size("tokens").alias("n")), [], []
    for level in range(LEVELS + 1):
        weights = regions.join(sizes, "x").groupBy("region").agg(F.sum("n").alias("w"), F.count("*").alias("k")).where("k > 1")
        weights = scratch.keep(weights, f"weights-{level}")
        done.append(regions.join(weights.where(F.col("w") <= bound), "region", "left_semi"))
        large = weights.where(F.col("w") > bound)
        if large.isEmpty():
            break
        large = large.select("region", "k", F.expr(f"cast(ceil(w / {max(1, bound // 2)}) as int)").alias("blocks"))
        big = scratch.keep(regions.join(large, "region"), f"large-{level}")
        if level == LEVELS:
            parts = big.withColumn("block", F.pmod(F.xxhash64("x"), "blocks").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
            done.append(parts.select(F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other")).alias("region"), "x"))
        elif level % 2:
            regions = scratch.keep(_by_prefix(big, sets, percent, scratch, level), f"split-{level}")
        else:
            found, parts = _by_pivots(big, sets, percent, scratch, level)
            links.append(found)
            regions = scratch.keep(parts, f"split-{level}")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, links


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = PERCENT, region_tokens: int = 2_000_000) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id.

    Two documents link when 100 * |A & B| >= percent * |A | B| for their sets of `size`-word shingles; component_id is the
    smallest doc_id that links reach. The result is exact:

    1. Documents with equal sets become one class, whose smallest doc_id stands for it.
    2. Of each class, the least hashes (30 % of the set) are counted over all classes. A document that shares fewer of them than
       any partner would have to is alone. Of the shared ones, the most frequent are left out as far as at least one stays common.
       This is a filter: unrelated documents are at distance 1 from every pivot, so no window could part them.
    3. Of the documents that keep a common shingle, the one of least hash is a pivot; its region are all that share one with it, so a
       group of copies has few regions however many shingles it shares.
    4. Regions of more than `region_tokens` shingles are split on the cluster: by sampled pivots, Voronoi cells and windows of the
       triangle inequality that replicate boundary documents, and by the rarest shingles within them, level by level.
    5. Each region joins recursively in one task: farthest-first pivots, their cells and windows, and exact comparison of parts that
       are small or that no window parts.

    Null or blank texts have no shingles and link with nothing. A null doc_id gets its n_shingles and a null component. Rows that
    repeat a doc_id count as one document; if their texts differ, the one of least fingerprint stands for it in the links. Other columns are ignored.
    Tables that joins meet on a key with many rows are written first, so that adaptive execution can split them; hot hashes are salted.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.keep(docs.mapInArrow(_signatures(percent, size), "doc_id long, print binary, n long, shared long, least array<long>"), "signed")
    hot = scratch.keep(_hot(signed), "hot")

    own = signed.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("print").alias("print"))
    classes = scratch.keep(own.groupBy("print").agg(F.min("doc_id").alias("x")), "classes")
    heads = signed.where("n > 0").join(classes.select(F.col("x").alias("doc_id"), F.col("print").alias("own")), "doc_id").where("print = own")
    tokens = _salted(heads.select(F.col("doc_id").alias("x"), "shared", F.explode("least").alias("h")), hot)
    counted = tokens.withColumn("df", F.coalesce("often", F.count("*").over(W.partitionBy("h", "salt")))).where("df > 1")
    met = counted.groupBy("x", "shared").agg(F.collect_list(F.struct("df", "h")).alias("met")).where("size(met) >= shared")
    kept = scratch.keep(met.select("x", F.expr("transform(slice(array_sort(met), 1, cast(size(met) - shared + 1 as int)), m -> m.h)").alias("keys")), "kept")

    cells = kept.select("x", F.explode("keys").alias("h"))
    regions = scratch.keep(_regions_of_keys(cells, scratch, "pivots").select(F.col("p").alias("region"), "x"), "regions")

    chosen = regions.select("x").distinct().join(own.withColumnRenamed("doc_id", "x"), "x")
    texts = docs.join(chosen.withColumnRenamed("x", "doc_id"), "doc_id")
    sets = scratch.keep(texts.mapInArrow(_sets(size), "x long, tokens array<long>").dropDuplicates(["x"]), "sets")

    parts, links = _bounded_regions(regions, sets, percent, region_tokens, scratch)
    dealt = parts.join(sets, "x").repartition("region").sortWithinPartitions("region", "x")
    found = dealt.select("region", "x", "tokens").mapInArrow(_join_regions(percent), "a long, b long")
    for more in links:
        found = found.unionByName(more)
    labels = components(found, scratch)

    named = classes.join(labels.withColumnRenamed("v", "x"), "x", "left").select(F.col("print").alias("own"), F.coalesce("c", "x").alias("component_id"))
    named = scratch.keep(named, "named")
    by_class = signed.where("n > 0 and doc_id is not null").select("doc_id", "print", "n")
    head = own.select("doc_id", F.col("print").alias("own"))
    out = by_class.join(head, "doc_id").join(named, "own").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = signed.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    result = scratch.keep(out.unionByName(rest), "result")
    scratch.drop_but("result")
    return result
