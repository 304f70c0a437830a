"""Hard negatives of anchors: an exact nearest-neighbour join over Voronoi cells, distributed by groups of anchors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Scratch

#: Most pivots; the candidates of a task; the anchors of a group; the rows of a matrix product.
PIVOTS, ROWS, GROUP, BLOCK = 1024, 8192, 1024, 2048
#: Beyond every score, as integer norms are under 2^31.
FAR = 1 << 62
#: Routes are broadcast up to this number of rows of 32 bytes.
BROADCAST_ROUTES = 250_000
#: Products of norms up to this are exact sums of doubles.
EXACT = float(1 << 53)


@dataclass
class Voronoi:
    """Pivots (integer vectors) in the space of one more dimension, in which every row has the norm `most`: there the rows nearest to an anchor are those of the largest inner product.

    An anchor has 0 in that dimension. lo and hi: distances of the nearest and farthest row of each cell to its pivot.
    """

    pivots: np.ndarray
    most: float
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None

    def _beyond(self, squares: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most**2 - squares, 0))

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each row, and its distance."""
        own = self._beyond((v * v).sum(1))
        inner = v @ self.pivots.T + np.outer(own, self._beyond((self.pivots**2).sum(1)))
        cell = inner.argmax(1)
        return cell, np.sqrt(np.maximum(2 * self.most**2 - 2 * inner[np.arange(len(v)), cell], 0))

    def from_anchors(self, v: np.ndarray) -> np.ndarray:
        """Distances of anchors to all pivots."""
        return np.sqrt(np.maximum((v * v).sum(1)[:, None] + self.most**2 - 2 * (v @ self.pivots.T), 0))

    def windows(self, v: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per anchor and cell, the distances from the pivot between which rows of a score from low to high can lie; empty where first > last.

        By the triangle inequality, and by the plane halfway between the cell's pivot and the anchor's own.
        """
        slack = 1e-6 * self.most + 1e-9
        d, squares = self.from_anchors(v), (v * v).sum(1) + self.most**2
        far = np.sqrt(np.maximum(squares - 2.0 * low, 0))[:, None] + slack
        near = np.sqrt(np.maximum(squares - 2.0 * high, 0))[:, None] - slack
        first = np.maximum(np.maximum(self.lo[None, :] - slack, d - far), near - d)
        last = np.minimum(self.hi[None, :] + slack, d + far)
        home = d.argmin(1)
        own = self._beyond((self.pivots**2).sum(1))
        apart = np.sqrt(np.maximum(2 * self.most**2 - 2 * (self.pivots @ self.pivots.T + np.outer(own, own)), 0))[home]
        plane = (d**2 - d.min(1)[:, None] ** 2) / (2 * np.maximum(apart, slack))
        last[plane > far + 1e-3 * self.most] = -np.inf
        return first, last

    def order(self) -> np.ndarray:
        """Pivots along a chain in which each is followed by the nearest of those left."""
        rest, at, out = np.ones(len(self.pivots), dtype=bool), 0, []
        for _ in range(len(self.pivots)):
            rest[at] = False
            out.append(at)
            d = ((self.pivots - self.pivots[at]) ** 2).sum(1)
            d[~rest] = np.inf
            at = int(d.argmin())
        return np.array(out)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a column as rows of doubles; shorter ones end in zeros."""
    n, values = len(column), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if n and (sizes == width).all():
        return values.reshape(n, width)
    out = np.zeros((n, width))
    out[np.repeat(np.arange(n), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


class Nearest:
    """The k best candidates of each anchor and slot. A slot takes scores from its low to its high; candidates come by ascending id."""

    def __init__(self, k: int, same: bool, most: float) -> None:
        self.k, self.same, self.exact = k, same, most * most < EXACT
        self.parts: list[tuple] = []
        self.ready = False

    def anchors(self, v: np.ndarray, rid: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.parts.append((v, rid, label, low, high))

    def _start(self) -> None:
        self.v, self.rid, self.label, self.low, self.high = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.best = np.full((*self.low.shape, self.k), -2 * FAR + 1, dtype=np.int64)
        self.ids = np.zeros_like(self.best)
        self.ready = True

    def feed(self, v: np.ndarray, rid: np.ndarray, label: np.ndarray, ids: np.ndarray) -> None:
        if not self.parts:
            return
        if not self.ready:
            self._start()
        at, step = 0, 64  # the first blocks are small, as nothing is ruled out yet
        while at < len(v):
            part = slice(at, at + step)
            self._block(v[part], rid[part], label[part], ids[part])
            at, step = at + step, min(2 * step, BLOCK)

    def _block(self, v: np.ndarray, rid: np.ndarray, label: np.ndarray, ids: np.ndarray) -> None:
        scores = self.v @ v.T if self.exact else self.v.astype(np.int64) @ v.T.astype(np.int64)
        fits = (self.label[:, None] == label[None, :]) == self.same
        if self.same:
            fits &= self.rid[:, None] != rid[None, :]
        for slot in range(self.low.shape[1]):
            least = np.maximum(self.low[:, slot], self.best[:, slot, -1] + 1)  # of equal scores the earlier, smaller id stays
            row, col = np.nonzero(fits & (scores >= least[:, None]) & (scores <= self.high[:, slot, None]))
            if len(row):
                self._merge(slot, row, scores[row, col].astype(np.int64), ids[col])

    def _merge(self, slot: int, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(row)
        rows = np.concatenate([np.repeat(touched, self.k), row])
        scores = np.concatenate([self.best[touched, slot].ravel(), score])
        found = np.concatenate([self.ids[touched, slot].ravel(), ids])
        order = np.lexsort((-scores, rows))  # stable, so by id among equals
        rows, scores, found = rows[order], scores[order], found[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = place < self.k
        self.best[rows[top], slot, place[top]] = scores[top]
        self.ids[rows[top], slot, place[top]] = found[top]

    def hits(self) -> pa.RecordBatch | None:
        if not self.ready:
            return None
        row, slot, place = np.nonzero(self.best > -2 * FAR + 1)
        return pa.RecordBatch.from_arrays([pa.array(self.rid[row]), pa.array(slot.astype(np.int32)), pa.array(self.ids[row, slot, place]), pa.array(self.best[row, slot, place])], names=["rid", "slot", "id", "score"])


HITS = "rid long, slot int, id long, score long"


def _joined(k: int, same: bool, most: float, width: int, slots: int):
    """Rows sorted by group, salt, anchors first, id -> hits of each group and salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nearest = None, Nearest(k, same, most)
        for batch in batches:
            place = np.stack([_numbers(batch.column(c)) for c in ("group", "salt", "kind")], 1)
            cuts = [0, *(np.nonzero((place[1:] != place[:-1]).any(1))[0] + 1), len(place)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if key != tuple(place[a, :2]):
                    if (done := nearest.hits()) is not None:
                        yield done
                    key, nearest = tuple(place[a, :2]), Nearest(k, same, most)
                v, rid, label = _matrix(part.column("v"), width), _numbers(part.column("rid")), _numbers(part.column("label"))
                if place[a, 2] == 0:
                    nearest.anchors(v, rid, label, *(_slots(part.column(c), slots, fill) for c, fill in (("low", FAR), ("high", -FAR))))
                else:
                    nearest.feed(v, rid, label, _numbers(part.column("id")))
        if (done := nearest.hits()) is not None:
            yield done

    return run


def _slots(column: pa.Array, slots: int, fill: int) -> np.ndarray:
    """Bounds of each slot; slots that an anchor hasn't take no score."""
    out = np.full((len(column), slots), fill, dtype=np.int64)
    sizes, values = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


@dataclass
class Join:
    """One search over the cells for all anchors: k best rows per slot, of the anchor's own label or of others."""

    cells: DataFrame
    scratch: Scratch
    space: Voronoi
    width: int
    counts: list[int]
    rows: int

    def _round(self, anchors: DataFrame, routes: DataFrame, k: int, same: bool, slots: int, few: bool) -> DataFrame:
        """Hits of the rows that the routes (group, cell, first, last) let through, dealt by group and salt; a task has `rows` candidates of a group or so."""
        spark = self.cells.sparkSession
        sizes = F.broadcast(spark.createDataFrame([(c, n, -(-n // self.rows)) for c, n in enumerate(self.counts)], "cell int, n long, blocks int"))  # a row per pivot
        salts = F.ceil(F.sum("n").over(W.partitionBy("group")) / self.rows).cast("int")
        routes = routes.join(sizes, "cell").withColumn("salts", F.greatest(salts, F.lit(1)))
        to = routes.select("group", "cell", "first", "last", "salts", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
        rows = self.cells.join(sizes.select("cell", "blocks"), "cell").withColumn("block", F.pmod(F.xxhash64("rid"), "blocks").cast("int"))
        none = F.lit(None).cast("array<long>")
        rows = rows.select("cell", "block", "d", "rid", "id", "label", "v").join(F.broadcast(to) if few else to, ["cell", "block"]).where("d between first and last")
        rows = rows.select("group", F.pmod(F.xxhash64("rid", F.lit(1)), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "rid", "id", "label", "v", none.alias("low"), none.alias("high"))
        own = anchors.join(routes.select("group", "salts").distinct(), "group")
        own = own.select("group", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.lit(0).alias("kind"), "rid", "id", "label", "v", "low", "high")
        dealt = own.unionByName(rows).repartition("group", "salt").sortWithinPartitions("group", "salt", "kind", "id", "rid")
        return dealt.mapInArrow(_joined(k, same, self.space.most, self.width, slots), HITS)

    def _routes(self, anchors: DataFrame) -> DataFrame:
        """(group, cell, first, last): the cells, and in them the distances from the pivot, that may hold what some anchor of a group looks for."""
        space, width = anchors.sparkSession.sparkContext.broadcast(self.space), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(a, 256) for a in range(0, len(batch), 256)):
                    group, v = _numbers(part.column("group")), _matrix(part.column("v"), width)
                    first, last = space.value.windows(v, part.column("least").to_numpy().astype(np.float64), part.column("most").to_numpy().astype(np.float64))
                    rows = [[], [], [], []]
                    for g in np.unique(group):
                        of, until = first[group == g], last[group == g]
                        empty = of > until
                        a, b = np.where(empty, np.inf, of).min(0), np.where(empty, -np.inf, until).max(0)
                        cell = np.nonzero(a <= b)[0]
                        for to, x in zip(rows, (np.full(len(cell), g), cell.astype(np.int32), a[cell], b[cell]), strict=True):
                            to.append(x)
                    if rows[0]:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in rows], names=["group", "cell", "first", "last"])

        bounds = anchors.select("group", "v", F.array_min("low").alias("least"), F.array_max("high").alias("most"))
        found = bounds.mapInArrow(run, "group long, cell int, first double, last double")
        return found.groupBy("group", "cell").agg(F.min("first").alias("first"), F.max("last").alias("last"))

    def best(self, anchors: DataFrame, k: int, same: bool, slots: int, few: bool, name: str) -> DataFrame:
        """(rid, slot, id, score, rank). anchors: group, rid, id, label, v, home, low, high (arrays by slot).

        The anchors' own cells are searched first. Where they hold k rows for a slot, the worst of these bounds what the other cells need to be searched for.
        """
        home = anchors.select("group", F.col("home").alias("cell"), F.lit(-1.0).alias("first"), F.lit(float("inf")).alias("last")).distinct()
        near = self.scratch.keep(_top(self._round(anchors, home, k, same, slots, few), k), f"{name}-home")
        floors = near.groupBy("rid", "slot").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k)
        floors = floors.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "floor"))).alias("floors"))  # a slot for each positive
        low = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.col("floors")[i], x)))
        bound = anchors.join(floors, "rid", "left").withColumn("low", F.when(F.col("floors").isNull(), F.col("low")).otherwise(low)).drop("floors")
        bound = self.scratch.keep(bound, f"{name}-anchors")
        routes = self.scratch.keep(self._routes(bound).join(home.select("group", "cell"), ["group", "cell"], "left_anti"), f"{name}-routes")
        rest = self._round(bound, routes, k, same, slots, few)
        return self.scratch.keep(_top(near.select("rid", "slot", "id", "score").unionByName(rest), k), f"{name}-best")


def _top(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("rid", "slot").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _quantised(rows: DataFrame, anchors: Column, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    """Rows that take part: rid (a key of the row), id, label, v (integers), square, anchor."""
    vector = F.col(vector_col)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    clean = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vector.isNotNull() & ~bad)
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    clean = clean.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), whole.alias("v"))
    clean = clean.withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).where(F.col("square") < float(FAR))
    return clean.select(F.monotonically_increasing_id().alias("rid"), "id", "label", "anchor", F.col("v").cast("array<int>").alias("v"), "square")


def mine_hard_negatives(
    rows: DataFrame, anchors: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0,
    positives: int = 5, negatives: int = 5, least_percent: int = 80, pivots: int | None = None, group: int = GROUP, rows_per_task: int = ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which `anchors` holds.

    A score is the inner product of floor(scale * x), exact. An anchor's positives are the `positives` best other rows of its label; the
    negatives of a positive are the `negatives` best rows of other labels that score from `least_percent` of it up to it. Higher
    scores come first, equal ones by id.

    Rows are assigned to the nearest of some pivots (about the square root of their number, 1,024 at most) after one more dimension has
    given all of them the same norm, which turns inner products into distances. Groups of anchors of neighbouring cells get
    only the rows that the cells' bounds don't rule out for all of them; a group's rows are spread over tasks of about
    `rows_per_task`, and what each finds is merged. Nothing is ruled out that could count: results don't depend on pivots, groups or tasks.

    Rows with a null id, label or vector, with a null or non-finite component, or with an integer norm of 2^31 or more (whose products
    are no longs) take no part. Shorter vectors count as ending in zeros. A repeated row is another row: it may be the anchor's
    own positive, and repeats the results if it is an anchor. Rows of one id, score and label rank in any order, which
    shows in no column. An empty table gives no rows; other columns are ignored.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "negatives")
    table = scratch.keep(_quantised(rows, anchors, id_col, vector_col, label_col, scale), "rows")
    all_ = table.agg(F.count("*").alias("n"), F.max("square").alias("square"), F.max(F.size("v")).alias("width")).first()
    if not all_.n:
        return spark.createDataFrame([], RESULT)
    k = pivots or min(PIVOTS, max(16, int(np.ceil(np.sqrt(all_.n)))))
    # twice as many as asked for, so that copies of a vector leave others; hashed with the row, so that copies come no earlier
    drawn = table.orderBy(F.xxhash64("v", "rid")).select("v").limit(2 * k).toArrow()
    chosen = np.unique(_matrix(drawn.column("v").combine_chunks(), all_.width), axis=0)[:k] if drawn.num_rows else np.zeros((1, all_.width))
    space, width = Voronoi(chosen, max(1.0, float(np.sqrt(all_.square)) * (1 + 1e-12))), all_.width
    sent = spark.sparkContext.broadcast(space)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, BLOCK) for a in range(0, len(batch), BLOCK)):
                v = _matrix(part.column("v"), width)
                cell, d = sent.value.cells(v)
                home = sent.value.from_anchors(v).argmin(1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rid", "id", "label", "anchor", "v")), pa.array(cell.astype(np.int32)), pa.array(d), pa.array(home.astype(np.int32))], names=["rid", "id", "label", "anchor", "v", "cell", "d", "home"])

    cells = scratch.keep(table.mapInArrow(assign, "rid long, id long, label long, anchor boolean, v array<int>, cell int, d double, home int"), "cells")
    n, homes = np.zeros(len(chosen), dtype=np.int64), np.zeros(len(chosen), dtype=np.int64)
    space.lo, space.hi = np.zeros(len(chosen)), np.full(len(chosen), -np.inf)
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect():  # a row per pivot
        n[r.cell], space.lo[r.cell], space.hi[r.cell] = r.n, r.lo, r.hi
    for r in cells.where("anchor").groupBy("home").agg(F.count("*").alias("n")).collect():
        homes[r.home] = r.n

    places, total, filled = [], 0, 0  # neighbouring homes share a group until it is full; a larger home has groups of its own
    for home in space.order():
        parts = max(1, -(-int(homes[home]) // group))
        if filled and filled + homes[home] > group:
            total, filled = total + 1, 0
        places.append((int(home), total, parts))
        filled += int(homes[home])
        if parts > 1:
            total, filled = total + parts, 0
    of_home = F.broadcast(spark.createDataFrame(places, "home int, first int, parts int"))  # a row per pivot
    seekers = cells.where("anchor").join(of_home, "home").select((F.col("first") + F.pmod(F.xxhash64("rid"), "parts")).cast("long").alias("group"), "rid", "id", "label", "v", "home")
    seekers = scratch.keep(seekers, "anchors")

    join = Join(cells, scratch, space, width, n.tolist(), rows_per_task)
    few = (total + 1) * int((-(-n // rows_per_task)).sum()) <= BROADCAST_ROUTES
    every = seekers.select("*", F.array(F.lit(-FAR)).alias("low"), F.array(F.lit(FAR)).alias("high"))
    alike = join.best(every, positives, True, 1, few, "positives")

    # 100 * negative >= least_percent * positive, in whole numbers
    lowest = F.ceil(F.col("score").cast("decimal(20,0)") * least_percent / 100).cast("long")
    slots = alike.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("rank", lowest.alias("low"), F.col("score").alias("high")))).alias("s"))  # `positives` at most
    asked = seekers.join(slots, "rid").select("group", "rid", "id", "label", "v", "home", F.col("s.low").alias("low"), F.col("s.high").alias("high"))
    other = join.best(scratch.keep(asked, "asked"), negatives, False, positives, few, "others")
    pairs = alike.select("rid", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = other.select("rid", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["rid", "slot"]).join(seekers.select("rid", F.col("id").alias("anchor_id")), "rid")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def oracle(scale: int = 256) -> str:
    """The contract's rows for DuckDB, by all pairs of anchors and rows."""
    return f"""
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor({scale} * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from e a, e b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select a, b, score from s where same qualify row_number() over (partition by a order by score desc, b) <= 5)
select p.a as anchor_id, p.b as positive_id, (row_number() over w)::int as rank, s.b as negative_id, p.score as positive_score, s.score as negative_score
from p join s on p.a = s.a where not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score
window w as (partition by p.a, p.b order by s.score desc, s.b) qualify row_number() over w <= 5"""
