"""Adaptive seeds, extended without gaps in both directions.

A seed is extended by x-drop from its first pair of letters to both sides.  Those that reach
the read's least seed score are extended again with a smaller drop, which ends them where

Proteins up to INDEX_LETTERS go to the workers as a sorted suffix array; for larger bases
:func:`seeding.adaptive_seed_join` finds the same matches by joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequences, statistics
from strandlake.operators import index, seeding
from strandlake.tables import stored

#: Letters of all proteins up to which their suffixes are sorted in each worker (200 bytes a letter).
INDEX_LETTERS = 500_000
SCHEMA = "doc_id long, frame int, prot_id long, q_pos int, r_pos int, length int, score long"
#: With the position in the peptide and the letters of the match that a seed was extended from.
ORIGIN = SCHEMA + ", at int, match int"
GAP = b"\0" * seeding.LONGEST
#: Letters of the proteins of a block, and pairs of a group, where seeds come from joins.
BLOCK_LETTERS, BLOCK_PAIRS = 2_000_000, 500_000
#: Seeds that are extended at once, letter by letter, and by eight letters at once.
PIECE, EIGHTS_PIECE = 1 << 18, 1 << 16
#: Counts of (peptide, protein, length) that are kept as one array; beyond that, pairs are sorted.
MOST_BINS = 1 << 23
HIGH, LOW_BITS = np.uint64(0x8080808080808080), np.uint64(0x7F7F7F7F7F7F7F7F)
#: Multipliers that gather a bit of each of eight bytes in the top byte: the first byte as the lowest bit, or the last.
FORWARD, BACKWARD = np.uint64(0x0102040810204080), np.uint64(0x8040201008040201)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts behind each other with gaps around them, and the place of each."""
    parts = [t.encode() for t in texts]
    starts = np.cumsum([len(GAP)] + [len(p) + len(GAP) for p in parts])[:-1]
    return np.frombuffer(GAP + b"".join(p + GAP for p in parts), np.uint8), starts.astype(np.int64)


def drop_off(q: np.ndarray, r: np.ndarray, i: np.ndarray, j: np.ndarray, step: int, x_drop: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, letters) of the best run of pairs from places ``i`` of ``q`` and ``j`` of ``r``, until
    the score lies ``x_drop`` or more under its best or a text ends."""
    best, length = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    live, now, k = np.arange(len(i)), np.zeros(len(i), np.int64), 0
    while len(live):
        a, b = q[i[live] + step * k], r[j[live] + step * k]
        inside = (a != 0) & (b != 0)
        live, a, b, now = live[inside], a[inside], b[inside], now[inside]
        now = now + table[a, b]
        k += 1
        more = now > best[live]
        best[live[more]], length[live[more]] = now[more], k
        on = best[live] - now < x_drop[live]
        live, now = live[on], now[on]
    return best, length


class Eights:
    """Extension by eight letters at once, for scores that are one number for equal letters and one for others.

    ``after[d << 8 | m]``: what eight pairs of letters do to a run that lies ``d`` under its best, where the bits of
    ``m`` mark the pairs that differ: the growth of its best times 1024, and how far it lies under it then, ``x_drop`` if
    it has ended.  ``first[m]``: the same for the first sixteen pairs, of a run that lies at its best.
    """

    def __init__(self, match: int, mismatch: int, same: np.ndarray, x_drop: int) -> None:
        self.same, self.x_drop = same, x_drop
        under, mask = (x.ravel() for x in np.meshgrid(np.arange(x_drop), np.arange(256), indexing="ij"))
        gain, live = np.zeros(len(under), np.int64), np.ones(len(under), bool)
        under = under.copy()
        for k in range(8):
            now = under - np.where(mask >> k & 1, mismatch, match)
            more = live & (now < 0)
            gain[more] -= now[more]
            under = np.where(live, np.maximum(now, 0), under)
            live &= under < x_drop
        self.after = (gain << 10 | np.where(live, under, x_drop)).astype(np.int32)
        one, two = self.after[np.arange(1 << 16) & 255], np.arange(1 << 16) >> 8
        on = one & 1023 < x_drop
        then = self.after[np.where(on, one & 1023, 0) << 8 | two]
        self.first = np.where(on, (one & ~1023) + then, one)

    @classmethod
    def of(cls, table: np.ndarray, x_drop: int) -> Eights | None:
        """None for other scores, or if a run may go on beyond the gaps around texts."""
        letters = np.arange(1, 128)
        inner = table[1:128, 1:128]
        diagonal = inner[letters - 1, letters - 1]
        match, mismatch = int(diagonal.max()), int(inner.min())
        other = inner[~np.eye(127, dtype=bool)]
        if not (match > 0 > mismatch and (other == mismatch).all() and np.isin(diagonal, (match, mismatch)).all()):
            return None
        if not 0 < x_drop <= min(-mismatch * (len(GAP) - 16), 1000):
            return None
        same = np.zeros(256, bool)
        same[letters] = diagonal == match
        return cls(match, mismatch, same, x_drop)

    def words(self, flat: np.ndarray, other: int) -> np.ndarray:
        """The eight bytes from each place on as a number; what is equal to nothing is ``other``."""
        plain = np.concatenate([np.where(self.same[flat], flat, np.uint8(other)), np.full(8, other, np.uint8)])
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(plain, 8)).view("<u8").ravel()

    def best(self, q: np.ndarray, r: np.ndarray, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """The scores of :func:`drop_off`, from the :meth:`words` of both texts."""
        i, j = (i, j) if step > 0 else (i - 7, j - 7)
        mine, theirs = np.empty((2, 2, len(i)), np.uint64)
        near, far = (0, 8) if step > 0 else (8, 0)
        at, place = (i, j) if step > 0 else (i - 8, j - 8)
        mask = self.masks(q[near:], r[near:], at, place, step, mine)
        more = self.masks(q[far:], r[far:], at, place, step, theirs)
        more <<= 8
        mask |= more
        out = self.first.take(mask, mode="clip")
        best, under = (out >> 10).astype(np.int64), out & 1023
        live = np.flatnonzero(under < self.x_drop)
        i, j, under = i[live] + 16 * step, j[live] + 16 * step, under[live].astype(np.int64)
        while len(live):
            under <<= 8
            under |= self.masks(q, r, i, j, step, mine[:, : len(live)])
            out = self.after.take(under, mode="clip")
            best[live] += out >> 10
            under = out & 1023
            on = np.flatnonzero(under < self.x_drop)
            live, i, j, under = live[on], i[on] + 8 * step, j[on] + 8 * step, under[on].astype(np.int64)
        return best

    @staticmethod
    def masks(q: np.ndarray, r: np.ndarray, i: np.ndarray, j: np.ndarray, step: int, room: np.ndarray) -> np.ndarray:
        """Which of eight pairs of letters differ, as bits; ``room`` for two rows of words, of which the first holds the result."""
        differ, other = room
        # all places lie in the texts; clip spares a copy
        np.take(q, i, out=differ, mode="clip")
        np.take(r, j, out=other, mode="clip")
        differ ^= other
        differ += LOW_BITS
        differ &= HIGH
        differ >>= np.uint64(7)
        differ *= FORWARD if step > 0 else BACKWARD
        differ >>= np.uint64(56)
        return differ.view(np.int64)


def extended(q: np.ndarray, r: np.ndarray, i: np.ndarray, j: np.ndarray, least: np.ndarray, x_drop: int, table: np.ndarray, eights: tuple[Eights, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """(seed, i, j, length, score) of the seeds at ``i`` and ``j`` that score ``least`` at least; ``eights`` with the
    words of ``r`` tell faster which these are."""

    def both(i: np.ndarray, j: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, ...]:
        left, n = drop_off(q, r, i, j, -1, drop, table)
        right, m = drop_off(q, r, i + 1, j + 1, 1, drop, table)
        n = np.maximum(n, 1)  # the seed's first pair is part of it
        return left + right, i - n + 1, j - n + 1, n + m

    good = []
    by_eights, theirs = eights or (None, None)
    mine = by_eights.words(q, 1) if eights else None
    piece = EIGHTS_PIECE if eights else PIECE
    for part in range(0, len(i), piece):
        some = slice(part, part + piece)
        if eights:
            score = by_eights.best(mine, theirs, i[some], j[some], -1) + by_eights.best(mine, theirs, i[some] + 1, j[some] + 1, 1)
        else:
            score = both(i[some], j[some], np.full(len(i[some]), x_drop))[0]
        good.append(part + np.flatnonzero(score >= least[some]))
    seed = np.concatenate(good) if good else np.empty(0, np.int64)
    score, a, b, length = both(i[seed], j[seed], np.rint(least[seed] * 0.1).astype(np.int64))
    return seed, a, b, length, score


class Index:
    """The sorted suffixes of all proteins, each of ``LONGEST`` letters."""

    def __init__(self, rows: list[tuple[int, str]], multiplicity: int, sampling: tuple[int, int] | None = None) -> None:
        rows = sorted(rows)
        self.ids, self.m = np.array([p for p, _ in rows], np.int64), multiplicity
        self.flat, self.starts = joined([aa for _, aa in rows])
        place = [s + (np.arange(max(len(aa) - 2, 0)) if sampling is None else sampled_places(aa, *sampling)) for s, (_, aa) in zip(self.starts, rows, strict=True)]
        place = np.concatenate(place) if place else np.empty(0, np.int64)
        found = windows(self.flat, place)
        # places go up with (prot_id, pos), so the first of equals is the smallest
        order = np.argsort(found, kind="stable")
        self.place, self.sorted = place[order], found[order]
        # letters by their place among those of the base, 0 for all others; so codes go up with the sorted order
        letters = np.flatnonzero(np.bincount(self.flat, minlength=256)[1:]) + 1
        self.number, self.letters = np.zeros(256, np.int64), len(letters) + 1
        self.number[letters] = np.arange(1, self.letters)
        code = self.prefix(self.number[self.flat], self.place, 3)
        self.small = np.bincount(code, minlength=self.letters**3)
        self.low = np.cumsum(self.small) - self.small
        more = self.number[self.flat[self.place + 3]] > 0
        self.four = np.zeros(self.letters**4, bool)
        self.four[self.prefix(self.number[self.flat], self.place[more], 4)] = True
        # the suffixes that share the first 4 to 7 letters with each, and the smallest place of these
        self.eight = eight(self.flat, self.place)
        self.begin, self.end, self.first = (np.zeros((4, len(order)), np.int32) for _ in range(3))
        for k in range(4 if len(order) else 0):
            some = self.eight >> np.uint64(32 - 8 * k)
            start = np.flatnonzero(np.concatenate(([True], some[1:] != some[:-1])))
            size = np.diff(np.append(start, len(some)))
            self.begin[k], self.end[k], self.first[k] = (np.repeat(x, size) for x in (start, start + size, np.minimum.reduceat(self.place, start)))

    def prefix(self, number: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """A number for the ``n`` letters from each place on; ``number`` holds the letters' own."""
        code = number[at]
        for k in range(1, n):
            code = code * self.letters + number[at + k]
        return code

    def matches(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in a joined text, of those in ``at``, the places in the proteins that they match, and on how many letters."""
        number = self.number[flat]
        code = self.prefix(number, at, 3)
        n = self.small[code]
        few, many = (n > 0) & (n <= self.m), n > self.m
        rare, rest, above = at[few], at[many], code[many]
        owner, spot = spread(self.low[code[few]], n[few])
        out = [(rare[owner], self.place[spot], np.full(len(owner), 3))]
        last = number[rest + 3]
        rest = rest[(last > 0) & self.four[above * self.letters + last]]
        if len(rest):
            # the neighbours in the sorted order by eight letters; matches on all of these are looked at once more
            key = eight(flat, rest)
            after = np.searchsorted(self.eight, key)
            length, near = np.zeros(len(rest), np.int64), after
            for side in (np.maximum(after - 1, 0), np.minimum(after, len(self.eight) - 1)):
                same = key ^ self.eight[side]
                here = sum(((same >> np.uint64(64 - 8 * k)) == 0).astype(np.int64) for k in range(1, 8)) + (same == 0)
                near = np.where(here > length, side, near)
                length = np.maximum(length, here)
            own = sum(((key >> np.uint64(64 - 8 * k)) & np.uint64(255) != 0).astype(np.int64) for k in range(1, 9))
            deep = (length == 8) & (own == 8)
            # behind the end of its text a match has no letters
            length = np.minimum(length, own)
            plain = np.flatnonzero(~deep & (length > 3))
            near, length, row = near[plain], length[plain], length[plain] - 4
            low, size = self.begin[row, near].astype(np.int64), (self.end[row, near] - self.begin[row, near]).astype(np.int64)
            few = size <= self.m
            owner, spot = spread(low[few], size[few])
            out.append((rest[plain][few][owner], self.place[spot], length[few][owner]))
            out.append((rest[plain][~few], self.first[row[~few], near[~few]].astype(np.int64), length[~few]))
            rest = rest[deep]
        if len(rest):
            key = windows(flat, rest)
            mine = key.view(np.uint8).reshape(len(rest), -1)
            after = np.searchsorted(self.sorted, key)
            theirs = self.sorted.view(np.uint8).reshape(len(self.sorted), -1)
            length = np.zeros(len(rest), np.int64)
            for near in (after - 1, after):
                near = np.clip(near, 0, len(theirs) - 1)
                length = np.maximum(length, np.argmin(np.concatenate([(mine == theirs[near]) & (mine != 0), np.zeros((len(rest), 1), bool)], axis=1), axis=1))
            keep = length > 3
            rest, mine, length = rest[keep], mine[keep], length[keep]
            beyond = np.arange(seeding.LONGEST) >= length[:, None]
            bound = lambda c: np.ascontiguousarray(np.where(beyond, np.uint8(c), mine)).view(f"S{seeding.LONGEST}").ravel()
            low, high = np.searchsorted(self.sorted, bound(0)), np.searchsorted(self.sorted, bound(127), side="right")
            few = high - low <= self.m
            owner, spot = spread(low[few], (high - low)[few])
            out.append((rest[few][owner], self.place[spot], length[few][owner]))
            if not few.all():
                pairs, back = np.unique(np.stack([low[~few], high[~few]], axis=1), axis=0, return_inverse=True)
                first = np.minimum.reduceat(np.append(self.place, 1 << 60), pairs.ravel())[::2]
                out.append((rest[~few], first[back.ravel()], length[~few]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def sampled_places(aa: str, p: int, q: int) -> np.ndarray:
    """The minimizers of a protein, as index.minimizers has them; all places of one of fewer than ``q`` letters."""
    if len(aa) < q:
        return np.arange(max(len(aa) - 2, 0))
    code = np.frombuffer(aa.encode(), np.uint8).astype(np.int64)
    sums = np.convolve(code, np.ones(p, np.int64), "valid")
    width = q - p + 1
    order = sums * len(sums) + np.arange(len(sums))[::-1]  # of equal sums the last
    least = np.lib.stride_tricks.sliding_window_view(order, width).argmin(1)
    return np.unique(np.arange(len(least)) + least)


#: The index that a worker made last, by its broadcast: tasks of one search share it.
HELD: dict[tuple, Index] = {}


def held_index(sent: Broadcast, multiplicity: int, sampling: tuple[int, int] | None) -> Index:
    rows = sent.value
    key = id(rows), multiplicity, sampling
    if key not in HELD or HELD[key].rows is not rows:
        HELD.clear()
        HELD[key] = Index(rows, multiplicity, sampling)
        HELD[key].rows = rows
    return HELD[key]


def windows(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The letters from each place on, to the end of the text."""
    if not len(at):
        return np.empty(0, f"S{seeding.LONGEST}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, seeding.LONGEST)[at]).view(f"S{seeding.LONGEST}").ravel()


def eight(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight letters from each place on as a number, in the order of their letters."""
    if not len(at):
        return np.empty(0, np.uint64)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, 8)[at]).view(">u8").ravel().astype(np.uint64)


def spread(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value): for each k the values low[k] to low[k] + n[k] - 1."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def least_score(length: np.ndarray, letters: int, lam: float, k: float) -> np.ndarray:
    """The least seed score of peptides, as :func:`statistics.min_seed_score`."""
    expected = (np.log(np.maximum(length, 1) * float(letters) * k) - statistics.SEED_EXPECTATION) / lam
    return np.floor(expected + 0.5).astype(np.int64)


def once(*columns: np.ndarray) -> list[np.ndarray]:
    """Rows of the columns, equal ones once."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return [c[order[new]] for c in columns]


def rows_of(doc: np.ndarray, frame: np.ndarray, prot: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, score: np.ndarray, *origin: np.ndarray, docs: pa.Array | None = None) -> pa.RecordBatch:
    """SCHEMA rows, equal ones once; with an ``origin`` (at, match), ORIGIN rows.  ``doc`` are places in ``docs``, if given."""
    fields = [f.split() for f in ORIGIN.split(", ")][: 7 + len(origin)]
    kinds = {"long": np.int64, "int": np.int32}
    columns = once(doc, frame, prot, a, b, length, score, *origin)
    arrays = [pa.array(c.astype(kinds[t])) for c, (_, t) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays([docs.take(arrays[0]) if docs is not None else arrays[0], *arrays[1:]], names=[n for n, _ in fields])


def texts_of(batches: Iterator[pa.RecordBatch], of_reads: bool) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[str]]]:
    """(different doc_ids, each peptide's place in them, frame, peptides) of some rows (doc_id, frame, aa), or ``of_reads``
    (doc_id, dna); of peptides of three letters at least."""
    for batch in batches:
        for some in (batch.slice(k, 6 if of_reads else 32) for k in range(0, batch.num_rows, 6 if of_reads else 32)):
            coded = some.column(0).dictionary_encode(null_encoding="encode")
            docs, doc = coded.dictionary, coded.indices.to_numpy()
            if of_reads:
                aa = [a for x in some.column(1).to_pylist() for a in (sequences.peptides(x) if x is not None else [""] * 6)]
                doc, frame = np.repeat(doc, 6), np.tile(np.array(sequences.FRAMES), len(doc))
            else:
                frame, aa = some.column(1).to_numpy(), some.column(2).to_pylist()
            long = np.flatnonzero([len(a or "") >= 3 for a in aa])
            if len(long):
                yield docs, doc[long], frame[long], [aa[x] for x in long.tolist()]


def seeds(reads: DataFrame, proteins: DataFrame, multiplicity: int, table: np.ndarray, lam: float, k: float, index_letters: int = INDEX_LETTERS, suffixes: DataFrame | None = None, origin: bool = False, sampling: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, frame, prot_id, q_pos, r_pos, length, score) from reads (doc_id, dna), or their peptides (doc_id, frame,
    aa), and proteins (prot_id, aa); ``table`` holds the scores by two letters' codes (alignment.score_table).
    ``sampling``: (p, q) of the minimizers at which matches start, None for all places.
    With their ``origin``, rows alike in all of these stay apart if they come from different matches."""
    proteins = proteins.select("prot_id", "aa").filter("aa IS NOT NULL")
    letters = int(proteins.agg(F.coalesce(F.sum(F.length("aa")), F.lit(0))).first()[0])
    x_drop = round(10 / lam)
    of_reads = "dna" in reads.columns

    if letters <= index_letters:
        sent = reads.sparkSession.sparkContext.broadcast([tuple(r) for r in proteins.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base = held_index(sent, multiplicity, sampling)
            by_eights = Eights.of(table, x_drop)
            eights = (by_eights, by_eights.words(base.flat, 2)) if by_eights else None
            for docs, doc, frame, aa in texts_of(batches, of_reads):
                flat, starts = joined(aa)
                size = np.array([len(a) for a in aa], np.int64)
                at = np.concatenate([s + np.arange(n - 2) for s, n in zip(starts.tolist(), size.tolist(), strict=True)])
                i, j, match = base.matches(flat, at)
                least = np.repeat(least_score(size, letters, lam, k), size + len(GAP))
                seed, a, b, length, score = extended(flat, base.flat, i, j, least[i - len(GAP)], x_drop, table, eights)
                owner, prot = np.searchsorted(starts, i[seed], side="right") - 1, np.searchsorted(base.starts, j[seed], side="right") - 1
                came = (i[seed] - starts[owner], match[seed]) if origin else ()
                yield rows_of(doc[owner], frame[owner], base.ids[prot], a - starts[owner], b - base.starts[prot], length, score, *came, docs=docs)

        return reads.select("doc_id", *(["dna"] if of_reads else ["frame", "aa"])).mapInArrow(run, ORIGIN if origin else SCHEMA)

    peptides = sequences.six_frames(reads.select("doc_id", "dna"), keep=False) if of_reads else reads
    peptides = peptides.select("doc_id", "frame", "aa").filter("length(aa) >= 3")
    query = index.suffixes(peptides.select(F.struct("doc_id", "frame").alias("prot_id"), "aa"), seeding.LONGEST).select(F.col("prot_id").alias("q_id"), F.col("pos").alias("q_pos"), "suffix")
    if suffixes is None:
        suffixes = index.suffixes(proteins, seeding.LONGEST)
        suffixes = index.sampled(suffixes, proteins, *sampling) if sampling else suffixes
    found = seeding.adaptive_seed_join(query, suffixes, multiplicity, small_partitions=True)
    pairs = stored(found.select("q_id.doc_id", "q_id.frame", F.col("q_pos").cast("int").alias("q_pos"), "prot_id", F.col("pos").cast("int").alias("r_pos"), F.col("len").cast("int").alias("match")), "pairs")
    return extended_pairs(pairs if origin else pairs.drop("match"), peptides, proteins, letters, table, x_drop, lam, k).distinct()


def seed_counts(peptides: DataFrame, proteins: DataFrame, multiplicity: int, index_letters: int = INDEX_LETTERS) -> DataFrame:
    """(q_id, prot_id, len, n): how many adaptive seeds of ``len`` letters peptides (q_id, aa) and proteins share.

    Proteins up to ``index_letters`` go to the workers, which count the seeds of each peptide where they find them;
    only peptides of a q_id that stands on several rows are added up after that.
    """
    proteins = proteins.select("prot_id", "aa").filter("aa IS NOT NULL")
    if int(proteins.agg(F.coalesce(F.sum(F.length("aa")), F.lit(0))).first()[0]) > index_letters:
        query = index.suffixes(peptides.withColumnRenamed("q_id", "prot_id"), seeding.LONGEST).select(F.col("prot_id").alias("q_id"), F.col("pos").alias("q_pos"), "suffix")
        out = seeding.adaptive_seed_join(query, index.suffixes(proteins, seeding.LONGEST), multiplicity, small_partitions=True)
        return out.groupBy("q_id", "prot_id", "len").agg(F.count("*").alias("n"))
    sent = peptides.sparkSession.sparkContext.broadcast([tuple(r) for r in proteins.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = held_index(sent, multiplicity, None)
        for some in (b.slice(k, 32) for b in batches for k in range(0, b.num_rows, 32)):
            flat, starts = joined(some.column(1).to_pylist())
            size = pc.binary_length(some.column(1)).to_numpy().astype(np.int64)
            at = np.concatenate([s + np.arange(n - 2) for s, n in zip(starts, size, strict=True)])
            i, j, match = base.matches(flat, at)
            owner, prot = np.searchsorted(starts, i, side="right") - 1, np.searchsorted(base.starts, j, side="right") - 1
            code = (owner * max(len(base.ids), 1) + prot) * (seeding.LONGEST + 1) + match
            if len(starts) * len(base.ids) * (seeding.LONGEST + 1) <= MOST_BINS:
                bins = np.bincount(code)
                code = np.flatnonzero(bins)
                n = bins[code]
            else:
                code, n = np.unique(code, return_counts=True)
            owner, match = np.divmod(code, seeding.LONGEST + 1)
            owner, prot = np.divmod(owner, max(len(base.ids), 1))
            columns = [some.column(0).take(pa.array(owner)), pa.array(base.ids[prot]), pa.array(match), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["q_id", "prot_id", "len", "n"])

    # of rows alike in q_id all go to one count
    again = stored(peptides.groupBy("q_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("q_id").alias("_q")), "again")
    out = peptides.filter("length(aa) >= 3").select("q_id", "aa").mapInArrow(run, "q_id long, prot_id long, len long, n long")
    if not again.limit(1).count():
        return out
    same = F.col("q_id").eqNullSafe(F.col("_q"))
    several = out.join(again, same, "left_semi").groupBy("q_id", "prot_id", "len").agg(F.sum("n").alias("n"))
    return out.join(again, same, "left_anti").union(several)


def extended_pairs(pairs: DataFrame, peptides: DataFrame, proteins: DataFrame, letters: int, table: np.ndarray, x_drop: int, lam: float, k: float, block_letters: int = BLOCK_LETTERS, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """SCHEMA rows of the pairs (doc_id, frame, q_pos, prot_id, r_pos) that reach the least score; ORIGIN rows of
    pairs with the letters of their ``match``.

    Pairs are grouped by blocks of proteins and, where a block has many, by chunks of reads.  A group gets
    each peptide and each protein of its pairs once, however many pairs they are in, so what is
    shuffled grows with the texts and with the pairs, not with their product.
    """
    blocks = max(1, math.ceil(letters / block_letters))
    block = F.pmod(F.xxhash64("prot_id"), F.lit(blocks)).cast("int")
    placed = pairs.withColumn("block", block)
    chunks = placed.groupBy("block").agg(F.ceil(F.count("*") / block_pairs).cast("int").alias("chunks"))
    placed = placed.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    wide = {"doc_id": "long", "frame": "int", "prot_id": "long", "aa": "string", "q_pos": "int", "r_pos": "int", "match": "int"}
    origin = "match" in pairs.columns
    filled = lambda rows: rows.select("block", "chunk", *(F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in wide.items()))
    mine = placed.select("block", "chunk", "doc_id", "frame").distinct().join(peptides, ["doc_id", "frame"])
    theirs = placed.select("block", "chunk", "prot_id").distinct().join(proteins, "prot_id")
    all_rows = filled(mine).union(filled(theirs)).union(filled(placed))

    def run(rows: pa.Table) -> pa.Table:
        pair = rows.filter(pc.is_valid(rows.column("q_pos")))
        texts = rows.filter(pc.is_valid(rows.column("aa")))
        q, q_at, q_len = placed_texts(texts.filter(pc.is_valid(texts.column("doc_id"))), ["doc_id", "frame"], pair)
        r, r_at, _ = placed_texts(texts.filter(pc.is_valid(texts.column("prot_id"))), ["prot_id"], pair)
        doc, frame, prot, q_pos, r_pos = (pair.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "frame", "prot_id", "q_pos", "r_pos"))
        by_eights = Eights.of(table, x_drop)
        eights = (by_eights, by_eights.words(r, 2)) if by_eights else None
        seed, a, b, length, score = extended(q, r, q_at + q_pos, r_at + r_pos, least_score(q_len, letters, lam, k), x_drop, table, eights)
        came = (q_pos[seed], pair.column("match").to_numpy()[seed]) if origin else ()
        return pa.Table.from_batches([rows_of(doc[seed], frame[seed], prot[seed], a - q_at[seed], b - r_at[seed], length, score, *came)])

    return all_rows.groupBy("block", "chunk").applyInArrow(run, ORIGIN if origin else SCHEMA)


def placed_texts(texts: pa.Table, key: list[str], pair: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts behind each other, and for each pair the place and the length of its own."""
    flat, starts = joined(texts.column("aa").to_pylist())
    place = {x: n for n, x in enumerate(zip(*(texts.column(c).to_pylist() for c in key), strict=True))}
    own = np.array([place[x] for x in zip(*(pair.column(c).to_pylist() for c in key), strict=True)], np.int64)
    size = pc.binary_length(texts.column("aa")).to_numpy().astype(np.int64)
    return flat, starts[own], size[own]
