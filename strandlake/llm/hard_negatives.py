"""Hard negatives by a multiway hyperplane tree with ranges (GNAT), exact.

Scores are inner products of whole numbers.  A further component lifts all rows to one norm,
so a score is a distance from the anchor (:func:`lifted`), and a window of scores is an annulus.

1. A bounded sample of rows gives the split points of the top level, far from each other.  Each row
   belongs to the cell of the nearest one, and each split point holds the range of its
   distances to every cell.  Cells are dealt to parts of about ``shard_rows`` rows.
2. An anchor meets only the cells whose ranges meet its annulus.  Where the sample already holds
   enough rows of the window, the lowest of their scores narrows it first.
3. A task builds the tree of one part (split points, ranges to sibling subtrees, exact leaves) and
   searches it for a block of anchors: siblings go if a range misses the annulus, which
   narrows as better rows are found.
4. The best of all parts are merged: first an anchor's positives, then, in a second search with
   the window of each positive, its negatives.

Memory: a task holds one part and one block (``block_rows``); the driver and every task hold the
sample (``SAMPLE`` rows) and SPLITS x SPLITS ranges.  Rows moved grow with anchors times the parts they
meet plus rows times blocks.

Defined results: rows with a null id, a null label, a null vector, or any null or non-finite
component take no part; shorter vectors end in zeros; rows alike in id, label and
vector count once; rows of an anchor's id are never its positives or negatives; rows of one
id with different labels or vectors are rows (and anchors) of their own; ties go by id; fewer
rows than asked for are all returned; a positive of negative score has no window; an anchor's positives of
one id and score count once; components
beyond the range of a long count as its ends, and so do scores; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import finite_vectors, matrix, shared_dir, stored, widest

#: Split points of a tree node, rows of a leaf, and rows of the sample that the top level is chosen from.
SPLITS, LEAF, SAMPLE = 16, 64, 1024
#: Whole numbers of doubles are exact below this.
EXACT = float(1 << 53)
LONG = np.iinfo(np.int64)


def quantised(rows: DataFrame, scale: int = 256, label: Column | None = None) -> DataFrame:
    """(vec_id, label, v): the rows that take part, with floor(scale * x) of each component."""
    kept = finite_vectors(rows, "embedding", F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"))
    whole = F.transform("v", lambda x: F.floor(scale * x).cast("long"))
    return kept.filter("vec_id IS NOT NULL AND label IS NOT NULL").select("vec_id", "label", whole.alias("v")).distinct()


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two whole-number matrices, exact."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(a.shape[1], 1) < EXACT:
        return (x @ y.T).astype(np.int64)
    out = a.astype(object) @ b.astype(object).T
    return np.clip(out, LONG.min, LONG.max).astype(np.int64)


def lifted(x: np.ndarray, norm2: float) -> np.ndarray:
    """The further component that lifts each row to the squared norm ``norm2``; an anchor has 0 there, so that
    its squared distance from a row is its own squared norm plus ``norm2`` less twice the score."""
    return np.sqrt(np.maximum(norm2 - (x.astype(np.float64) ** 2).sum(1), 0))


def between(x: np.ndarray, hx: np.ndarray, y: np.ndarray, hy: np.ndarray) -> np.ndarray:
    """Distances of the lifted rows of two matrices."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    square = (x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T + (hx[:, None] - hy) ** 2
    return np.sqrt(np.maximum(square, 0))


def far_apart(x: np.ndarray, h: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows, each the farthest from those before; rows that are all alike give one."""
    chosen = [0]
    near = between(x, h, x[:1], h[:1])[:, 0]
    while len(chosen) < min(count, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, between(x, h, x[chosen[-1:]], h[chosen[-1:]])[:, 0])
        near[chosen] = 0
    return np.array(chosen)


class Tree:
    """Split points with the ranges of their distances to the subtrees beside them; leaves hold rows.

    ``x``: whole-number vectors in order of id, with ``ids``, ``labels`` and the common squared norm."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, norm2: float) -> None:
        self.x, self.ids, self.labels, self.norm2, self.h = x, ids, labels, norm2, lifted(x, norm2)
        self.top = self.node(np.arange(len(x)))

    def node(self, rows: np.ndarray) -> tuple:
        if len(rows) > LEAF:
            # a spread of the node's rows stands for all when split points are chosen
            some = rows[:: max(1, len(rows) // (4 * SPLITS * SPLITS))]
            points = some[far_apart(self.x[some], self.h[some], SPLITS)]
            far = between(self.x[rows], self.h[rows], self.x[points], self.h[points])
            cell = far.argmin(1)
            parts = [np.flatnonzero(cell == c) for c in range(len(points))]
            parts = [p for p in parts if len(p)]
            if len(parts) > 1:
                ranges = np.array([[far[p].min(0), far[p].max(0)] for p in parts])
                return points, ranges[:, 0], ranges[:, 1], [self.node(rows[p]) for p in parts]
        return (rows,)

    def search(self, q: np.ndarray, own: np.ndarray, label: np.ndarray, same: np.ndarray, low: np.ndarray, high: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the ``count`` best rows of each query's window low to high, with its own label
        or another, best first, ties by id; LONG.min where there are fewer."""
        best, ids = np.full((len(q), count), LONG.min), np.full((len(q), count), LONG.max)
        norm = (q.astype(np.float64) ** 2).sum(1)

        def go(node: tuple, live: np.ndarray) -> None:
            if not len(live):
                return
            if len(node) == 1:
                leaf(node[0], live)
                return
            points, near, far, children = node
            to = between(q[live], np.zeros(len(live)), self.x[points], self.h[points])
            for c, child in enumerate(children):
                go(child, live[meets(to, near[c], far[c], *annulus(norm[live], self.norm2, np.maximum(low[live], best[live, -1]), high[live]))])

        def leaf(rows: np.ndarray, live: np.ndarray) -> None:
            s = scores(q[live], self.x[rows])
            fits = (self.labels[rows] == label[live, None]) == same[live, None]
            fits &= (self.ids[rows] != own[live, None]) & (s >= low[live, None]) & (s <= high[live, None]) & (s >= best[live, -1:])
            hit = fits.any(1)
            if hit.any():
                live, s, fits = live[hit], s[hit], fits[hit]
                s = np.concatenate([best[live], np.where(fits, s, LONG.min)], 1)
                who = np.concatenate([ids[live], np.where(fits, self.ids[rows], LONG.max)], 1)
                # the bitwise complement turns the order of whole numbers round
                order = np.lexsort((who, ~s), axis=1)[:, :count]
                best[live], ids[live] = np.take_along_axis(s, order, 1), np.take_along_axis(who, order, 1)

        go(self.top, np.arange(len(q)))
        return best, ids


def annulus(norm: np.ndarray, norm2: float, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distances from an anchor between which rows of the scores ``low`` to ``high`` lie, widened
    by more than the rounding of distances."""
    inner = np.sqrt(np.maximum(norm + norm2 - 2 * high.astype(np.float64), 0))
    outer = np.sqrt(np.maximum(norm + norm2 - 2 * low.astype(np.float64), 0))
    slack = 1e-6 * (np.sqrt(norm + norm2) + 1)
    return inner - slack, outer + slack


def meets(to: np.ndarray, near: np.ndarray, far: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Whether rows between ``near`` and ``far`` from all split points can lie in the annuli of queries
    at the distances ``to`` from them."""
    least = np.maximum(to - outer[:, None], inner[:, None] - to)
    return ((far >= least) & (near <= to + outer[:, None])).all(1)


class Top:
    """The tree's top level: sample, split points, ranges of the cells and their numbers of parts."""

    def __init__(self, sample: list, norm2: float) -> None:
        self.width = max((len(r["v"]) for r in sample), default=0)
        self.x = np.zeros((len(sample), self.width), np.int64)
        for k, r in enumerate(sample):
            self.x[k, : len(r["v"])] = r["v"]
        self.ids, self.labels = (np.array([r[c] for r in sample], np.int64) for c in ("vec_id", "label"))
        self.norm2 = norm2
        points = far_apart(self.x, lifted(self.x, norm2), SPLITS) if len(sample) else np.empty(0, np.int64)
        self.points = self.x[points]
        self.h = lifted(self.points, norm2)
        self.near, self.far, self.parts = np.full((len(points), len(points)), np.inf), np.full((len(points), len(points)), -np.inf), np.ones(len(points), np.int64)

    def to(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Distances of lifted rows from the split points."""
        points = np.zeros((len(self.points), x.shape[1]), np.int64)
        points[:, : self.width] = self.points
        return between(x, h, points, self.h)


def indexed(rows: DataFrame, shard_rows: int) -> tuple[DataFrame, Top]:
    """``rows`` (vec_id, label, v) with their cell and part, stored; and the top level."""
    each = stored(rows, "vectors")
    norm2 = float(each.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).first()[0] or 0)
    top = Top(each.orderBy(F.xxhash64("vec_id", "label"), "vec_id").limit(SAMPLE).collect(), norm2)
    if not len(top.ids):
        return each.select("*", F.lit(0).alias("cell"), F.lit(0).alias("part")), top
    sent = each.sparkSession.sparkContext.broadcast(top)

    def distances(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(batch.schema.get_field_index("v")), max(widest(batch), sent.value.width), np.int64)
        return sent.value.to(x, lifted(x, sent.value.norm2))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = distances(batch).argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["vec_id", "label", "v", "cell"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far, cell = distances(batch), batch.column(batch.schema.get_field_index("cell")).to_numpy()
                for c in np.unique(cell):
                    own = far[cell == c]
                    n = own.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c)), pa.array(np.arange(n, dtype=np.int32)), pa.array(own.min(0)), pa.array(own.max(0)), pa.array(np.full(n, len(own)))], names=["cell", "point", "near", "far", "n"])

    dealt = stored(each.mapInArrow(cells, "vec_id long, label long, v array<long>, cell int"), "cells")
    # SPLITS squared rows at most
    found = dealt.mapInArrow(ranges, "cell int, point int, near double, far double, n long").groupBy("cell", "point").agg(F.min("near"), F.max("far"), F.sum("n")).collect()
    for cell, point, near, far, n in found:
        top.near[cell, point], top.far[cell, point], top.parts[cell] = near, far, math.ceil(n / shard_rows)
    parts = F.element_at(F.array(*(F.lit(int(n)) for n in top.parts)), F.col("cell") + 1)
    return dealt.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("int")), top


def searched(rows: DataFrame, top: Top, asks: DataFrame, same: bool, count: int, block_rows: int) -> DataFrame:
    """(ask, anchor_id, rank, vec_id, score) of the ``count`` best rows in the window of each of ``asks`` (ask,
    anchor_id, label, v, low, high), of its own label (``same``) or of another."""
    spark = rows.sparkSession
    blocks = max(1, math.ceil(asks.count() / block_rows))
    sent = spark.sparkContext.broadcast(top)
    names = ["ask", "anchor_id", "label", "v", "low", "high"]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = sent.value
        for batch in batches:
            for part in range(0, batch.num_rows, 1024):
                some = pa.Table.from_batches([batch.slice(part, 1024)])
                q = matrix(some.column("v"), max(widest(some), top.width), np.int64)
                low, high = some.column("low").to_numpy().copy(), some.column("high").to_numpy()
                sample = np.zeros((len(top.x), q.shape[1]), np.int64)
                sample[:, : top.width] = top.x
                s = scores(q, sample)
                fits = ((top.labels == some.column("label").to_numpy()[:, None]) == same) & (top.ids != some.column("anchor_id").to_numpy()[:, None]) & (s >= low[:, None]) & (s <= high[:, None])
                if s.shape[1] >= count:
                    low = np.maximum(low, np.sort(np.where(fits, s, LONG.min), 1)[:, -count])
                norm, to = (q.astype(np.float64) ** 2).sum(1), top.to(q, np.zeros(len(q)))
                ring = annulus(norm, top.norm2, low, high)
                who, cell = np.nonzero(np.array([meets(to, top.near[c], top.far[c], *ring) for c in range(len(top.points))]).T.reshape(len(q), -1))
                moved = some.take(pa.array(who)).set_column(names.index("low"), "low", pa.array(low[who])).append_column("cell", pa.array(cell.astype(np.int32)))
                yield from moved.combine_chunks().to_batches()

    def run(some: pa.Table, held: pa.Table) -> pa.Table:
        out = {"ask": pa.array([], pa.int64()), "anchor_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())}
        if some.num_rows and held.num_rows:
            held = held.sort_by([("vec_id", "ascending"), ("label", "ascending")])
            width = widest(some, held)
            tree = Tree(matrix(held.column("v"), width, np.int64), held.column("vec_id").to_numpy(), held.column("label").to_numpy(), sent.value.norm2)
            ask, own, label, low, high = (some.column(c).to_numpy() for c in ("ask", "anchor_id", "label", "low", "high"))
            best, ids = tree.search(matrix(some.column("v"), width, np.int64), own, label, np.full(len(ask), same), low, high, count)
            who, place = np.nonzero(ids != LONG.max)
            out = {"ask": ask[who], "anchor_id": own[who], "vec_id": ids[who, place], "score": best[who, place]}
        return pa.table(out)

    parts = F.element_at(F.array(*(F.lit(int(n)) for n in [*top.parts, 1])), F.col("cell") + 1)
    live = asks.select(*names).mapInArrow(cells, "ask long, anchor_id long, label long, v array<long>, low long, high long, cell int")
    live = live.withColumns({"part": F.explode(F.sequence(F.lit(0), parts - 1)), "block": F.pmod(F.xxhash64("ask", "anchor_id"), F.lit(blocks)).cast("int")})
    held = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["cell", "part", "block"]
    found = live.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(run, "ask long, anchor_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("ask", "anchor_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= count)


def mined(
    rows: DataFrame, asks: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), shard_rows: int = 8192, block_rows: int = 65536
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors of ``rows``
    (vec_id, label, v; see :func:`quantised`) that meet the condition ``asks``.

    ``positives``, ``negatives``: how many of each.  ``share``: the hundredths of the positive's score
    between which a negative's lies.
    """
    shared_dir(rows.sparkSession)
    held, top = indexed(rows, shard_rows)
    whole = [F.lit(LONG.min).alias("low"), F.lit(LONG.max).alias("high")]
    anchors = held.filter(asks).select(F.xxhash64("label", "v").alias("ask"), F.col("vec_id").alias("anchor_id"), "label", "v")
    anchors = stored(anchors, "anchors")
    first = stored(searched(held, top, anchors.select("*", *whole), True, positives, block_rows).drop("rank"), "positives")
    # the smallest whole number with 100 * n >= low * score, and the largest with 100 * n <= high * score
    bound = "cast((cast(score AS decimal(38,0)) * {0} + {1}) div 100 AS long)"
    windows = anchors.join(first.filter("score >= 0").withColumnRenamed("vec_id", "positive_id").withColumnRenamed("score", "positive_score"), ["ask", "anchor_id"])
    windows = windows.withColumn("score", F.col("positive_score")).withColumns({"low": F.expr(bound.format(share[0], 99)), "high": F.expr(bound.format(share[1], 0))})
    # the positives of an anchor are told from each other by id and score
    windows = windows.withColumn("ask", F.xxhash64("ask", "positive_id", "positive_score")).dropDuplicates(["ask", "anchor_id"])
    windows = stored(windows.drop("score"), "windows")
    found = searched(held, top, windows, False, negatives, block_rows)
    named = found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(windows.select("ask", "anchor_id", "positive_id", "positive_score"), ["ask", "anchor_id"])
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
