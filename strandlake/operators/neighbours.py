"""The longest prefixes that query suffixes share with the suffixes of a base, by ranges of the sorted order.

In lexicographic order the longest match of a suffix is with one of its neighbours.  Some suffixes of
the base, chosen by hashes, split the order into ranges of about RANGE_ROWS: as each range starts with
a suffix of the base, a query's neighbours lie in its own range, or are the split that follows, which
every task knows.  Ranges with many queries are dealt to several tasks, each of which holds the
range's suffixes; equal query suffixes of a task are looked up once.

The suffixes that share a prefix lie behind each other.  Where they reach over a split, they are
counted from all ranges: such a prefix starts a split, so there are at most ``letters`` of them for
each (:func:`over_splits`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from strandlake.tables import stored

#: Suffixes of the base in a range, of queries in a task, and the most splits that tasks know (at most LONGEST bytes each).
RANGE_ROWS, QUERY_ROWS, MOST_SPLITS = 200_000, 400_000, 100_000
#: Suffixes looked at for each split.
LOOKED_AT = 4


def fixed(column: pa.ChunkedArray | pa.Array, letters: int) -> np.ndarray:
    """Strings as numpy bytes of one width."""
    return np.array([s.encode() for s in column.to_pylist()], f"S{letters}")


def letters_of(x: np.ndarray) -> np.ndarray:
    """The letters of fixed-width strings as a matrix, 0 behind the end."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the rows of two letter matrices."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def splits_of(base: DataFrame, rows: int, letters: int) -> np.ndarray:
    """Suffixes of ``base`` that part its order into ranges of about ``rows``, in order."""
    n = base.count()
    ranges = min(max(1, math.ceil(n / rows)), MOST_SPLITS)
    if ranges == 1:
        return np.empty(0, f"S{letters}")
    every = max(1, n // (ranges * LOOKED_AT))
    some = base.filter(F.pmod(F.xxhash64("prot_id", "pos"), F.lit(every)) == 0).select("suffix").collect()
    some = np.unique(np.array([r["suffix"].encode() for r in some], f"S{letters}"))
    return some[:: max(1, round(len(some) / ranges))][1:]


def ranged(rows: DataFrame, splits: Broadcast) -> DataFrame:
    """``rows`` with the number of their suffix's range."""
    at = rows.columns.index("suffix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = splits.value
        for batch in batches:
            number = np.searchsorted(known, fixed(batch.column(at), known.itemsize), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], names=[*batch.schema.names, "range"])

    return rows.mapInArrow(run, with_number(rows, "range"))


def with_number(rows: DataFrame, name: str) -> StructType:
    """The schema of ``rows`` with one more whole number."""
    return StructType([*rows.schema.fields, StructField(name, IntegerType())])


class Range:
    """The sorted suffixes of one range, and the split behind it."""

    def __init__(self, rows: pa.Table, number: int, splits: np.ndarray, multiplicity: int) -> None:
        prot, pos, suffix = rows.column("prot_id").to_numpy(), rows.column("pos").to_numpy(), fixed(rows.column("suffix"), splits.itemsize)
        order = np.lexsort((pos, prot, suffix))
        self.prot, self.pos, self.suffix, self.m = prot[order], pos[order], suffix[order], multiplicity
        self.rank = np.empty(len(order), np.int64)
        self.rank[np.lexsort((self.pos, self.prot))] = np.arange(len(order))
        self.by_rank = np.argsort(self.rank)
        self.before = number > 0
        self.behind = splits[number : number + 1]
        self.letters = letters_of(np.concatenate([self.suffix, self.behind]))

    def longest(self, key: np.ndarray) -> np.ndarray:
        """Length of the longest prefix of each of ``key`` that a suffix of the base starts with."""
        mine, after = letters_of(key), np.searchsorted(self.suffix, key)
        length = np.zeros(len(key), np.int64)
        for near in (after - 1, after):
            inside = (near >= 0) & (near < len(self.letters))
            length[inside] = np.maximum(length[inside], shared(mine[inside], self.letters[near[inside]]))
        return length

    def found(self, key: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, end, over) of the suffixes of this range with the first ``length`` letters of each of ``key``,
        and whether there may be more of them in other ranges."""
        mine, beyond = letters_of(key), np.arange(key.itemsize) >= length[:, None]
        bound = lambda c: np.ascontiguousarray(np.where(beyond, np.uint8(c), mine)).view(key.dtype).ravel()
        first, end = np.searchsorted(self.suffix, bound(0)), np.searchsorted(self.suffix, bound(127), side="right")
        over = self.before & (first == 0) & (end > first)
        if len(self.behind):
            over |= (end == len(self.suffix)) & (shared(mine, np.broadcast_to(self.letters[-1], mine.shape)) >= length)
        return first, end, over

    def smallest(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of the smallest (protein, position) from ``first`` to before ``end``."""
        pairs, back = np.unique(np.stack([first, end], 1), axis=0, return_inverse=True)
        low = np.minimum.reduceat(np.append(self.rank, 1 << 60), pairs.ravel())[::2]
        return self.by_rank[low][back.ravel()]


def matches(queries: DataFrame, base: DataFrame, multiplicity: int, letters: int, range_rows: int = RANGE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(q_id, q_pos, len, prot_id, pos): the longest prefix, four letters at least, of each query suffix (q_id,
    q_pos, suffix) among those of ``base`` (prot_id, pos, suffix), with all that share it, or the first if they are
    more than ``multiplicity``.  Both hold ``letters`` letters at most."""
    spark = queries.sparkSession
    cut = lambda rows: rows.withColumn("suffix", F.substring("suffix", 1, letters)).filter(F.length("suffix") >= 4)
    # of equal suffixes one more than ``multiplicity`` tells that they are too many
    place = F.row_number().over(Window.partitionBy("suffix").orderBy("prot_id", "pos"))
    base = stored(cut(base.select("prot_id", "pos", "suffix")).withColumn("_k", place).filter(F.col("_k") <= multiplicity + 1).drop("_k"), "suffixes")
    splits = spark.sparkContext.broadcast(splits_of(base, range_rows, letters))
    starts = F.broadcast(base.select(F.substring("suffix", 1, 4).alias("_p")).distinct())  # 27 letters to the power of four at most
    asked = cut(queries.select("q_id", "q_pos", "suffix")).join(starts, F.substring("suffix", 1, 4) == F.col("_p"), "left_semi")
    asked, held = ranged(asked, splits), ranged(base, splits)
    # at most MOST_SPLITS + 1 numbers
    sizes = {r["range"]: math.ceil(r["count"] / query_rows) for r in asked.groupBy("range").count().collect()}
    tasks = spark.sparkContext.broadcast(np.array([sizes.get(k, 1) for k in range(len(splits.value) + 1)], np.int32))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tasks.value[batch.column(batch.num_columns - 1).to_numpy()])], names=[*batch.schema.names, "tasks"])

    many = asked.mapInArrow(dealt, with_number(asked, "tasks"))
    asked = many.withColumn("task", F.pmod(F.xxhash64("q_id", "q_pos"), F.col("tasks")).cast("int"))
    each = held.mapInArrow(dealt, with_number(held, "tasks")).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))

    def run(some: pa.Table, rows: pa.Table) -> pa.Table:
        number = (some if some.num_rows else rows).column("range")[0].as_py()
        base, key = Range(rows, number, splits.value, multiplicity), fixed(some.column("suffix"), letters)
        key, back = np.unique(key, return_inverse=True)
        length = base.longest(key)
        first, end, over = base.found(key, length)
        length, first, end, over = length[back], first[back], end[back], over[back]
        own = (length > 3) & ~over
        few, many = np.flatnonzero(own & (end - first <= multiplicity)), np.flatnonzero(own & (end - first > multiplicity))
        size = end[few] - first[few]
        owner = np.repeat(few, size)
        spot = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        if len(many):
            owner, spot = np.concatenate([owner, many]), np.concatenate([spot, base.smallest(first[many], end[many])])
        left = np.flatnonzero((length > 3) & over)
        who = np.concatenate([owner, left])
        none = np.arange(len(who)) >= len(owner)
        prefix = [None] * len(owner) + [k[:n].decode() for k, n in zip(key[back[left]].tolist(), length[left].tolist(), strict=True)]
        spot = np.concatenate([spot, np.zeros(len(left), np.int64)])
        prot, pos = (np.append(x, 0)[np.where(none, -1, spot)] for x in (base.prot, base.pos))
        return pa.table(
            {"q_id": some.column("q_id").take(pa.array(who)), "q_pos": some.column("q_pos").take(pa.array(who)), "len": length[who], "prot_id": pa.array(prot.astype(np.int64), mask=none), "pos": pa.array(pos.astype(np.int32), mask=none), "prefix": pa.array(prefix, pa.string())}
        )

    new = [StructField("len", LongType()), StructField("prot_id", LongType()), StructField("pos", IntegerType()), StructField("prefix", StringType())]
    schema = StructType([queries.schema["q_id"], queries.schema["q_pos"], *new])
    out = asked.groupBy("range", "task").cogroup(each.groupBy("range", "task")).applyInArrow(run, schema)
    if not len(splits.value):
        return out.drop("prefix")
    out = stored(out, "matches")
    over = out.filter("prefix IS NOT NULL").select("q_id", "q_pos", "len", "prefix").join(over_splits(held, splits, multiplicity, letters), "prefix")
    places = F.when(F.col("n") <= multiplicity, F.col("places")).otherwise(F.slice("places", 1, 1))
    return out.filter("prefix IS NULL").drop("prefix").union(over.select("q_id", "q_pos", "len", F.explode(places).alias("x")).select("q_id", "q_pos", "len", "x.prot_id", "x.pos"))


def over_splits(held: DataFrame, splits: Broadcast, multiplicity: int, letters: int) -> DataFrame:
    """(prefix, n, places): for each prefix of a split, how many suffixes of the base start with it, and the
    first of them by protein and position, as many as count."""

    def run(rows: pa.Table) -> pa.Table:
        number, known = rows.column("range")[0].as_py(), splits.value
        prot, pos, mine = rows.column("prot_id").to_numpy(), rows.column("pos").to_numpy(), letters_of(fixed(rows.column("suffix"), letters))
        order = np.lexsort((pos, prot))
        prot, pos, mine = prot[order], pos[order], mine[order]
        edges = letters_of(known[max(number - 1, 0) : number + 1])
        out = []
        for k, edge in enumerate(edges):
            # the prefixes that both edges share are counted with the first
            least = 4 if not k else max(4, int(shared(edges[:1], edges[1:])[0]) + 1)
            same = shared(mine, np.broadcast_to(edge, mine.shape))
            for n in range(least, int(same.max(initial=0)) + 1):
                at = np.flatnonzero(same >= n)
                some = at[: multiplicity + 1]
                out.append((edge[:n].tobytes().decode(), len(at), [{"prot_id": int(a), "pos": int(b)} for a, b in zip(prot[some], pos[some], strict=True)]))
        kind = pa.list_(pa.struct([("prot_id", pa.int64()), ("pos", pa.int32())]))
        return pa.table({"prefix": pa.array([x[0] for x in out], pa.string()), "n": pa.array([x[1] for x in out], pa.int64()), "places": pa.array([x[2] for x in out], kind)})

    found = held.groupBy("range").applyInArrow(run, "prefix string, n long, places array<struct<prot_id: long, pos: int>>")
    first = F.slice(F.array_sort(F.flatten(F.collect_list("places"))), 1, multiplicity + 1)
    return found.groupBy("prefix").agg(F.sum("n").alias("n"), first.alias("places"))
