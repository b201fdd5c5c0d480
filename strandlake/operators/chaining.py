"""From seeds to chains: the densest diagonal window, the better strand, linear chains.

:func:`diagonal_windows` and :func:`strand_choice` are the steps as window functions and aggregates.
:func:`chains` takes all steps in one pass: seeds are dealt by read and protein and sorted once,
and kernels go over the bounds of the groups in whole Arrow batches, without a Python call for
each group.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seeds of a group up to which all groups are made linear at once; larger ones go one by one.
TOGETHER = 256


def diagonal_windows(seeds: DataFrame, proteins: DataFrame, weight: str | None = None) -> DataFrame:
    """The densest window of diagonals of each (doc_id, strand, prot_id).

    A window reaches max(6 % of the protein in bases, 10) bases from its first seed; the
    order key is divided by that width, which makes the range the same for all proteins.
    Most seeds win, then the first window.  Extended seeds, where a whole homology may be one
    seed, go by the sum of a ``weight`` column (in ``n_seeds``) instead of their number.
    """
    lengths = proteins.select("prot_id", F.length("aa").alias("ref_len"))
    step = seeds.join(lengths, "prot_id").withColumns(
        {
            "strand": F.when(F.col("frame") > 0, F.lit("+")).otherwise(F.lit("-")),
            "nt": 3 * F.col("q_pos") + F.abs("frame") - 1,
            "width": F.greatest(F.lit(0.06) * 3 * F.col("ref_len"), F.lit(10.0)),
        }
    )
    step = step.withColumn("y", F.col("nt") - 3 * F.col("r_pos") + 3 * F.col("ref_len"))
    step = step.withColumn("z", F.col("y") / F.col("width"))
    reach = Window.partitionBy("doc_id", "strand", "prot_id").orderBy("z").rangeBetween(0, 1)
    counted = step.withColumn("n", (F.sum(weight) if weight else F.count("*")).over(reach))
    best = counted.groupBy("doc_id", "strand", "prot_id").agg(F.max(F.struct("n", (-F.col("y")).alias("y"))).alias("b"), F.first("width").alias("width"), F.first("ref_len").alias("ref_len"))
    return best.select("doc_id", "strand", "prot_id", F.col("b.n").alias("n_seeds"), (-F.col("b.y")).cast("long").alias("y"), F.col("width"), F.col("ref_len").cast("long").alias("ref_len"))


def strand_choice(windows: DataFrame) -> DataFrame:
    """One strand per (doc_id, prot_id): the minus strand only if it has more seeds."""
    best = F.max_by(F.struct("strand", "n_seeds", "y", "width", "ref_len"), F.struct("n_seeds", (F.col("strand") == "+").alias("plus")))
    return windows.groupBy("doc_id", "prot_id").agg(best.alias("b")).select("doc_id", "prot_id", "b.*")


class Seeds:
    """Seeds of whole groups (read, protein), in order of group, then strand or frame, then diagonal.

    ``part`` numbers the strands (or frames) of all groups, in which windows are sought."""

    def __init__(self, doc: np.ndarray, prot: np.ndarray, frame: np.ndarray, nt: np.ndarray, r: np.ndarray, length: np.ndarray, score: np.ndarray, ref_len: np.ndarray, by_frame: bool) -> None:
        kind = np.where(frame > 0, 0, 4) + (np.abs(frame) if by_frame else 0)
        y = nt - 3 * r + 3 * ref_len
        order = np.lexsort((length, r, nt, y, kind, prot, doc))
        self.doc, self.prot, self.kind, self.nt, self.r, self.length, self.score, self.ref_len, self.y = (x[order] for x in (doc, prot, kind, nt, r, length, score, ref_len, y))
        new_group = changes(self.doc, self.prot)
        self.group = np.cumsum(new_group) - 1
        self.part_begin = np.flatnonzero(new_group | changes(self.kind))
        self.part = np.cumsum(new_group | changes(self.kind)) - 1

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of each part's heaviest window, of equals the first."""
        width = np.maximum(0.06 * 3 * self.ref_len, 10.0)
        last = np.floor(self.y + width).astype(np.int64)
        # parts lie behind each other on one axis, farther apart than any window reaches
        span = int(last.max()) + 1
        end = np.searchsorted(self.part * span + self.y, self.part * span + last, side="right")
        upto = np.concatenate(([0], np.cumsum(self.score)))
        weight = upto[end] - upto[: len(end)]
        # the first of equal diagonals has the whole window
        order = np.lexsort((np.arange(len(end)), -weight, self.part))
        first = order[self.part_begin]
        self.weight = weight[first]
        return first, end[first]

    def chosen(self) -> np.ndarray:
        """The places of the seeds in the window of each group's best strand (or frame); plus wins ties,
        then the smaller frame."""
        first, end = self.windows()
        owner = self.group[self.part_begin]
        order = np.lexsort((self.kind[self.part_begin], -self.weight, owner))
        best = order[changes(owner[order])]
        size = end[best] - first[best]
        return np.repeat(first[best], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def linear(group: np.ndarray, nt: np.ndarray, r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which seeds stay: in the order given, a seed goes if it lies behind in the read and ahead in the
    protein, or the other way, against one that stays.  ``group`` numbers go up."""
    begin = np.flatnonzero(changes(group))
    size = np.diff(np.append(begin, len(group)))
    kept = np.ones(len(group), bool)
    for k in range(1, int(size[size <= TOGETHER].max(initial=1))):
        one = begin[(size > k) & (size <= TOGETHER)] + k
        mine = np.repeat(one, k)
        other = mine - np.tile(np.arange(1, k + 1), len(one))
        held = kept[other]
        mine, other = mine[held], other[held]
        before = (nt[other] < nt[mine]) | ((nt[other] == nt[mine]) & ((r[other] < r[mine]) | ((r[other] == r[mine]) & (n[other] <= n[mine]))))
        against = np.where(before, r[other] > r[mine], r[other] < r[mine])
        kept[mine[against]] = False
    for b, s in zip(begin[size > TOGETHER].tolist(), size[size > TOGETHER].tolist(), strict=True):
        line: list[tuple[int, int, int]] = []
        for k, x in enumerate(zip(nt[b : b + s].tolist(), r[b : b + s].tolist(), n[b : b + s].tolist(), strict=True), b):
            at = bisect.bisect(line, x)
            if (not at or line[at - 1][1] <= x[1]) and (at == len(line) or line[at][1] >= x[1]):
                line.insert(at, x)
            else:
                kept[k] = False
    return kept


CHAINS = "doc_id long, prot_id long, strand string, start long, stop long, r_start long, r_stop long, n long, seeds array<struct<q: long, r: long>>"


def chained(rows: pa.Table, by_frame: bool) -> pa.Table:
    """CHAINS rows of whole groups of seeds."""
    doc, prot, frame, q, r, length, score, ref_len = (rows.column(k).to_numpy().astype(np.int64) for k in range(8))
    s = Seeds(doc, prot, frame, 3 * q + np.abs(frame) - 1, r, length, score, ref_len, by_frame)
    at = s.chosen()
    # the heaviest first; equal seeds of two frames cannot be, as the place in the read tells frames apart
    at = at[np.lexsort((s.length[at], s.r[at], s.nt[at], -s.score[at], s.group[at]))]
    group, nt, r, n = s.group[at], s.nt[at], s.r[at], s.length[at]
    kept = linear(group, nt, r, n)
    begin = np.flatnonzero(changes(group))
    line = np.flatnonzero(kept)
    first = np.flatnonzero(changes(group[line]))
    of = line[first]
    start, r_start = (np.minimum.reduceat(x[line], first) for x in (nt, r))
    stop, r_stop = np.maximum.reduceat(nt[line] + 3 * n[line], first), np.maximum.reduceat(r[line] + n[line], first)
    count = np.diff(np.append(first, len(line)))
    # all seeds of a window, those of the chain before the others
    order = np.lexsort((np.arange(len(at)), ~kept, group))
    middles = pa.StructArray.from_arrays([pa.array((nt + 3 * (n // 2))[order]), pa.array((r + n // 2)[order])], names=["q", "r"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)), pa.int32()), middles)
    strand = np.where(s.kind[at[of]] < 4, "+", "-")
    columns = [s.doc[at[of]], s.prot[at[of]], pa.array(strand.tolist(), pa.string()), start, stop, r_start, r_stop, count, lists]
    return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=[c.split()[0] for c in CHAINS.split(", ")[:9]])


def chains(seeds: DataFrame, proteins: DataFrame, by_frame: bool = False) -> DataFrame:
    """CHAINS of each read and protein: in the heaviest window of its better strand (or, ``by_frame``, of its
    best frame), the seeds without those that go backwards against a heavier one, merged to an interval;
    ``seeds`` (q, r) are the middles of all seeds of the window, those of the chain first, the
    heaviest first.

    Seeds are taken by score, so that a stray one cannot push out heavier ones.  A task holds the seeds of a
    few Arrow batches and of one read and protein, no more than the read's letters.
    """
    lengths = proteins.select("prot_id", F.length("aa").cast("long").alias("ref_len"))
    placed = seeds.select("doc_id", "prot_id", *(F.col(c).cast("long").alias(c) for c in ("frame", "q_pos", "r_pos", "length", "score"))).join(lengths, "prot_id")

    ordered = placed.select("doc_id", "prot_id", "frame", "q_pos", "r_pos", "length", "score", "ref_len")
    return whole_groups(ordered, lambda rows: iter(chained(rows, by_frame).combine_chunks().to_batches()), CHAINS)


MERGED = "doc_id long, prot_id long, strand string, frame int, q_start long, q_stop long, r_start long, r_stop long, score long"


def merge(doc: np.ndarray, prot: np.ndarray, frame: np.ndarray, nt: np.ndarray, r: np.ndarray, length: np.ndarray, score: np.ndarray) -> list[np.ndarray]:
    """Columns of MERGED, but for the strand, of whole groups (read, protein, strand) of seeds.

    Along the read: a seed that begins within the one before it, on its diagonal and in its frame, is one with
    it, with the higher score of both; a seed that lies within the one before it in read and protein goes,
    until none does; of what still overlaps in the read, the later one begins whole codons later.
    """
    kind = frame < 0
    order = np.lexsort((length, frame, r, nt, kind, prot, doc))
    doc, prot, frame, kind, nt, r, length, score = (x[order] for x in (doc, prot, frame, kind, nt, r, length, score))
    new = changes(doc, prot, kind)
    ahead = np.diff(nt, prepend=0)
    joined = ~new & ~changes(frame) & (ahead == 3 * np.diff(r, prepend=0)) & (ahead < 3 * np.concatenate(([0], length[:-1])))
    first = np.flatnonzero(~joined)
    last = np.append(first[1:], len(nt)) - 1
    doc, prot, frame, kind, start, r_start = (x[first] for x in (doc, prot, frame, kind, nt, r))
    r_stop, score = r[last] + length[last], np.maximum.reduceat(score, first)
    stop = start + 3 * (r_stop - r_start)
    while True:
        inside = np.zeros(len(start), bool)
        inside[1:] = (start[1:] >= start[:-1]) & (stop[1:] <= stop[:-1]) & (r_start[1:] >= r_start[:-1]) & (r_stop[1:] <= r_stop[:-1])
        inside &= ~changes(doc, prot, kind)
        if not inside.any():
            break
        doc, prot, frame, kind, start, stop, r_start, r_stop, score = (x[~inside] for x in (doc, prot, frame, kind, start, stop, r_start, r_stop, score))
    cut = np.where(changes(doc, prot, kind), 0, np.maximum(np.concatenate(([0], stop[:-1])) - start, 0))
    cut = np.minimum(-(-cut // 3) * 3, stop - start)
    left = start + cut < stop
    return [x[left] for x in (doc, prot, frame, start + cut, stop, r_start + cut // 3, r_stop, score)]


def merged(seeds: DataFrame) -> DataFrame:
    """MERGED seeds of (doc_id, frame, prot_id, q_pos, r_pos, length, score); see :func:`merge`.

    A task holds the seeds of a few Arrow batches and of one read and protein."""
    columns = ["doc_id", "prot_id", "frame", "q_pos", "r_pos", "length", "score"]

    def of_groups(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, prot, frame, q, r, length, score = (rows.column(c).to_numpy() for c in columns)
        out = merge(doc, prot, frame, 3 * q + np.abs(frame) - 1, r, length, score)
        strand = pa.array(np.where(out[2] > 0, "+", "-").tolist(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), strand, pa.array(out[2].astype(np.int32)), *map(pa.array, out[3:])], names=[c.split()[0] for c in MERGED.split(", ")])

    placed = seeds.select(*(F.col(c).cast("long").alias(c) for c in columns))
    return whole_groups(placed, of_groups, MERGED)


def whole_groups(rows: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on tables of whole groups (doc_id, prot_id; the first two columns), a few Arrow batches at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, prot = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # the last group may go on in the next batch
            last = int(np.flatnonzero(changes(doc, prot))[-1])
            if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (doc[0], prot[0]) or last:
                held.append(batch.slice(0, last))
                yield from work(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from work(pa.Table.from_batches(held))

    return rows.repartition("doc_id", "prot_id").sortWithinPartitions("doc_id", "prot_id").mapInArrow(run, schema)
