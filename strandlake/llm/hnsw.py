"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

1. Rows with equal vectors are one node, which holds the smallest ids of theirs that a search
   can return (a window with a limit, so that copies are cut to a few before the shuffle).
2. Nodes are dealt to shards of about ``shard_rows`` by their ids.  A task builds the graph of a
   shard: nodes in the order of their levels, so that each level is a prefix of the shard; a
   batch of nodes at a time walks the graph so far.  The graphs are a stored table, with one
   flat array of neighbours for each node.
3. Blocks of queries meet each shard once: beams of ``ef`` go down its levels.  Distances of
   what they find are computed anew, in double precision on the original vectors.
4. The nearest of all shards are merged by query.

Memory: a task holds one shard (``shard_rows`` vectors and arrays of links) and one block
(``block_rows`` queries).  Rows moved grow with queries times shards plus vectors times blocks, as
every query has to see every shard; larger shards need less work on large tables.

Defined results: rows with a null id, and vectors that are null, empty, zero or hold null or
non-finite components, take no part; shorter vectors end in zeros; rows alike in id and vector
count once; rows of one id with different vectors are rows (and queries) of their own, and none
of them is a result of another; ties go by id; a query with fewer candidates gets them all; an
empty table gives no rows; further columns are ignored; vectors of any length and size work.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import finite_vectors, matrix, shared_dir, stored, widest

#: Links that a new node makes in a level, and the most it may hold in the lowest level.
LINKS, MOST = 16, 32
#: Candidates kept in a walk while the graph is built.
BUILD_EF = 64
#: Nodes inserted, or queries walked, at once; and candidates opened in a step of a walk.
BATCH, WIDE = 512, 4
GRAPH = "shard int, node int, level int, ids array<long>, v array<double>, links array<int>"


def near_lists(found: np.ndarray, dist: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` nearest of each row, in order of distance."""
    order = np.argsort(dist, axis=1, kind="stable")[:, :size]
    return np.take_along_axis(found, order, 1), np.take_along_axis(dist, order, 1)


def walk(links: np.ndarray, x: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) of the ``ef`` nearest that each of ``q`` meets from its ``start`` on.

    All rows of ``q`` go a step at a time.  ``len(x)`` stands for no node."""
    none, rows = len(x), np.arange(len(q))
    seen = np.zeros((len(q), none + 1), bool)
    seen[:, none] = True
    seen[rows, start] = True
    found, dist = np.full((len(q), ef), none), np.full((len(q), ef), np.inf, np.float32)
    opened = np.ones((len(q), ef), bool)
    found[:, 0], dist[:, 0], opened[:, 0] = start, ((x[start] - q) ** 2).sum(1), False
    live = rows
    while len(live):
        best = np.argsort(opened[live], axis=1, kind="stable")[:, :WIDE]
        at = live[:, None]
        fresh = ~opened[at, best]
        new = links[np.where(fresh, found[at, best], 0)]
        new = np.where(fresh[:, :, None], new, none).reshape(len(live), -1)
        opened[at, best] = True
        new = np.where(seen[at, new], none, new)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = none
        seen[at, new] = True
        far = np.full(new.shape, np.inf, np.float32)
        who, place = np.nonzero(new < none)
        far[who, place] = ((x[new[who, place]] - q[live[who]]) ** 2).sum(1)
        all_found, all_dist = np.concatenate([found[live], new], 1), np.concatenate([dist[live], far], 1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :ef]
        found[live], dist[live] = np.take_along_axis(all_found, order, 1), np.take_along_axis(all_dist, order, 1)
        done = np.concatenate([opened[live], new == none], 1)
        opened[live] = np.take_along_axis(done, order, 1) | (found[live] == none)
        live = live[~opened[live].all(axis=1)]
    return found, dist


def apart(x: np.ndarray, found: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Of candidates in order of distance, up to ``most``: those that lie nearer to the node than to any
    one taken before, then the nearest of the others, so that groups of copies stay reachable."""
    none = len(x)
    out = np.full((len(found), most), none)
    for part in range(0, len(found), BATCH):
        f, d = found[part : part + BATCH], dist[part : part + BATCH]
        some = x[np.minimum(f, none - 1)]
        square = (some**2).sum(2)
        between = square[:, :, None] + square[:, None, :] - 2 * some @ some.transpose(0, 2, 1)
        alive, taken = f < none, np.zeros(len(f), np.int64)
        left = alive.copy()
        for k in range(f.shape[1]):
            take = np.flatnonzero(alive[:, k] & (taken < most))
            out[part + take, taken[take]] = f[take, k]
            taken[take] += 1
            alive[take] &= between[take, k] >= d[take]
            left[take, k] = False
        order = np.argsort(~left, axis=1, kind="stable")
        rest = np.where(np.take_along_axis(left, order, 1), np.take_along_axis(f, order, 1), none)
        slot = np.arange(most) - taken[:, None]
        fill = (slot >= 0) & (slot < rest.shape[1])
        out[part : part + BATCH][fill] = np.take_along_axis(rest, np.clip(slot, 0, rest.shape[1] - 1), 1)[fill]
    return out


def add(links: np.ndarray, x: np.ndarray, first: int, found: np.ndarray, dist: np.ndarray) -> None:
    """Links the nodes from ``first`` on with those chosen of their candidates, both ways."""
    none, most = len(x), links.shape[1]
    chosen = apart(x, found, dist, min(LINKS, most))
    links[first : first + len(chosen), : chosen.shape[1]] = chosen
    source, place = np.nonzero(chosen < none)
    if not len(source):
        return
    target, source = chosen[source, place], source + first
    far = ((x[target] - x[source]) ** 2).sum(1)
    order = np.lexsort((source, far, target))
    target, source = target[order], source[order]
    begins = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
    rank = np.arange(len(target)) - np.repeat(begins, np.diff(np.append(begins, len(target))))
    near = rank < most
    new = np.full((len(begins), most), none)
    new[np.searchsorted(target[begins], target[near]), rank[near]] = source[near]
    nodes = target[begins]
    lists = np.concatenate([links[nodes], new], 1)
    # nodes of one batch may have chosen each other
    lists.sort(axis=1)
    lists[:, 1:][lists[:, 1:] == lists[:, :-1]] = none
    lists.sort(axis=1)
    full = (lists < none).sum(1) > most
    links[nodes[~full]] = lists[~full, :most]
    if full.any():
        some, at = lists[full], nodes[full]
        d = np.full(some.shape, np.inf, np.float32)
        who, place = np.nonzero(some < none)
        d[who, place] = ((x[some[who, place]] - x[at[who]]) ** 2).sum(1)
        links[at] = apart(x, *near_lists(some, d, some.shape[1]), most)


def entry(levels: list[np.ndarray], sizes: list[int], x: np.ndarray, q: np.ndarray, down_to: int) -> np.ndarray:
    """A node near each of ``q``, from the levels above ``down_to``."""
    start = np.zeros(len(q), np.int64)
    for level in range(len(sizes) - 1, down_to, -1):
        start = walk(levels[level], x[: sizes[level]], q, start, 4)[0][:, 0]
    return start


def graph(x: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
    """The links of each level, the lowest first; nodes go by falling ``level``."""
    sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
    levels: list[np.ndarray] = [np.empty(0)] * len(sizes)
    for k in reversed(range(len(sizes))):
        n = sizes[k]
        own = x[:n]
        levels[k] = np.full((n, LINKS if k else MOST), n)
        done = 0
        while done < n:
            last = min(n, done + min(max(done, LINKS), BATCH))
            q = own[done:last]
            within = ((q[:, None] - q[None]) ** 2).sum(2) if len(q) <= 64 else np.maximum((q**2).sum(1)[:, None] + (q**2).sum(1) - 2 * q @ q.T, 0)
            np.fill_diagonal(within, np.inf)
            ids = np.where(np.isinf(within), n, np.arange(done, last))
            found, dist = near_lists(ids, within, BUILD_EF)
            if done:
                # nodes of the next level are the first of this one; until all are in, walks start at the first
                above = k + 1 < len(sizes) and done >= sizes[k + 1]
                start = entry(levels, sizes, x, q, k) if above else np.zeros(len(q), np.int64)
                older = walk(levels[k][:done].clip(max=done), own[:done], q, start, BUILD_EF)
                far = np.where(older[0] < done, older[0], n), older[1]
                found, dist = near_lists(np.concatenate([found, far[0]], 1), np.concatenate([dist, far[1]], 1), BUILD_EF)
            add(levels[k], own, done, found, dist)
            done = last
    return levels


def scaled(x: np.ndarray, by: float) -> np.ndarray:
    """Vectors as single-precision numbers that no square of theirs overflows; walks use these."""
    return (x / by).astype(np.float32)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of two matrices, summed component by component."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += (a[:, k] - b[:, k]) ** 2
    return np.sqrt(total)


def built(nodes: DataFrame) -> DataFrame:
    """GRAPH rows of nodes (shard, ids, v): ``links`` are the lowest level's, then those of each level above."""

    def run(rows: pa.Table) -> pa.Table:
        first = np.array([x[0] for x in rows.column("ids").to_pylist()], np.int64)
        # levels fall off by powers of LINKS, and are the same whenever a shard is built again
        u = (hashed(first.astype(np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        level = np.floor(-np.log(np.maximum(u, 2.0**-53)) / math.log(LINKS)).astype(np.int64)
        order = np.lexsort((first, u))
        rows, level = rows.take(pa.array(order)), level[order]
        x = matrix(rows.column("v"), widest(rows))
        levels = graph(scaled(x, np.abs(x).max()), level)
        links = [[int(c) for part in levels[: lev + 1] for c in np.where(part[k] < len(part), part[k], -1)] for k, lev in enumerate(level)]
        return pa.table(
            {"shard": rows.column("shard"), "node": pa.array(np.arange(len(order)), pa.int32()), "level": pa.array(level, pa.int32()), "ids": rows.column("ids"), "v": rows.column("v"), "links": pa.array(links, pa.list_(pa.int32()))}
        )

    return nodes.select("shard", "ids", "v").groupBy("shard").applyInArrow(run, GRAPH)


def hashed(x: np.ndarray) -> np.ndarray:
    """Numbers mixed so that all bits depend on all (any such mixing does)."""
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def index(rows: DataFrame, k: int = 10, shard_rows: int = 8192) -> DataFrame:
    """The stored graphs of all ``rows`` (vec_id, embedding), for searches of up to ``k`` neighbours."""
    shared_dir(rows.sparkSession)
    each = valid(rows).distinct()
    place = F.row_number().over(Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id"))
    copies = each.withColumn("place", place).filter(F.col("place") <= k + 1)
    nodes = stored(copies.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    shards = max(1, math.ceil(nodes.count() / shard_rows))
    return stored(built(nodes.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int"))), "graph")


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    return finite_vectors(rows, "embedding", F.col("vec_id").cast("long").alias("vec_id")).filter("vec_id IS NOT NULL AND exists(v, x -> x <> 0)")


def nearest(graphs: DataFrame, queries: DataFrame, k: int = 10, ef: int = 256, block_rows: int = 65536) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each of ``queries`` (vec_id, embedding)."""
    mine = stored(valid(queries).distinct(), "queries")
    blocks = max(1, math.ceil(mine.count() / block_rows))
    shards = (graphs.agg(F.max("shard")).first()[0] or 0) + 1
    asked = mine.select(F.col("vec_id").alias("query_id"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "v")
    held = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(some: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if some.num_rows and rows.num_rows:
            rows = rows.sort_by("node")
            width = widest(some, rows)
            exact, q = matrix(rows.column("v"), width), matrix(some.column("v"), width)
            by = max(np.abs(exact).max(), np.abs(q).max())
            x, level = scaled(exact, by), rows.column("level").to_numpy()
            sizes = [int((level >= n).sum()) for n in range(int(level.max()) + 1)]
            lists = rows.column("links").combine_chunks()
            flat, begins = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            skip, levels = 0, []
            for n, size in enumerate(sizes):
                width_n = LINKS if n else MOST
                own = flat[(begins[:size] + skip)[:, None] + np.arange(width_n)].astype(np.int64)
                levels.append(np.where(own < 0, size, own))
                skip += width_n
            ids, names = rows.column("ids").combine_chunks(), some.column("query_id").to_numpy()
            id_flat, id_at = ids.flatten().to_numpy(), ids.offsets.to_numpy()
            for part in range(0, len(q), BATCH):
                piece = q[part : part + BATCH]
                walked = scaled(piece, by)
                found = walk(levels[0], x, walked, entry(levels, sizes, x, walked, 0), max(ef, k + 1))[0]
                who, place = np.nonzero(found < len(x))
                node = found[who, place]
                score = distances(piece[who], exact[node])
                n = id_at[node + 1] - id_at[node]
                one = np.repeat(np.arange(len(node)), n)
                vec = id_flat[id_at[node][one] + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)]
                keep = vec != names[part + who[one]]
                who, vec, score = who[one][keep], vec[keep], score[one][keep]
                order = np.lexsort((vec, score, who))
                who, vec, score = who[order], vec[order], score[order]
                begin = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else np.empty(0, np.int64)
                top = np.arange(len(who)) - np.repeat(begin, np.diff(np.append(begin, len(who)))) < k
                out.append(pa.table({"query_id": names[part + who[top]], "h": some.column("h").to_numpy()[part + who[top]], "vec_id": vec[top], "score": score[top]}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "h": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    asked = asked.withColumn("h", F.xxhash64("v"))
    found = asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInArrow(run, "query_id long, h long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "h").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(rows: DataFrame, asks: Column, k: int = 10, **how: int) -> DataFrame:
    """The nearest other rows of those of ``rows`` that meet the condition ``asks``."""
    return nearest(index(rows, k), rows.filter(asks), k, **how)
