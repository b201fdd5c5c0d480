"""Gapped alignment of bases with a protein, with or without frame shifts.

The only kernel that is no DataFrame expression.  Many chains are aligned at once: from a seed,
the dynamic program goes to both sides an amino acid at a time, and a row of it holds the cells
around the seed's diagonal for all chains of a batch.  A chain leaves the batch when its row
falls ``x_drop`` under its best score.  Scores come first; only alignments that pass the raw
score wanted are traced, by one byte of moves per cell.  Chains that cannot reach that score from any
of their seeds, by an upper bound that is far cheaper than the score (:meth:`Batch.most`), are not aligned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequences import CODONS

FAR = -(1 << 28)
#: The same in 16 bits, and the largest sum of drop, penalties and scores that leaves them room.
FAR_SHORT, MOST_SHORT = -8_000, 6_000
#: Cells on each side of the diagonal, in bases (gaps and shifts of that many bases in sum).
BAND = 96
#: Bytes of moves that a task holds, and chains aligned at once; chains, and letters of their reads, that are prepared together.
MOVES, CHAINS = 32 << 20, 256
PREPARED, PREPARED_LETTERS = 16384, 4 << 20
#: Seeds that are bounded at once, amino acids whose codons are gathered for them, and those after which values start from 0 again.
BOUNDED, ROWS, RESTART = 1024, 32, 8
#: A protein's letter behind its ends.
NONE = 130
#: How a cell was reached: codon with amino acid, with a base read twice, with a base skipped, amino acid alone.
PAIR, TWICE, SKIP, DOWN, DOWN_ON, RIGHT, RIGHT_ON = 1, 2, 3, 4, 8, 16, 32
CODON_TABLE = np.zeros(64, np.uint8)
for _codon, _aa in CODONS.items():
    CODON_TABLE["TCAG".index(_codon[0]) * 16 + "TCAG".index(_codon[1]) * 4 + "TCAG".index(_codon[2])] = ord(_aa)
#: Bases of the other strand, as sequences.reverse_complement has them.
COMPLEMENT = str.maketrans("ACGT", "TGCA")
BASE_CODE = np.full(256, 64, np.uint8)
BASE_CODE[[ord(c) for c in "TCAG"]] = np.arange(4)


def score_table(rows: list[tuple[str, str, int]] | None, match: int, mismatch: int) -> np.ndarray:
    """Scores by two letters' codes: those of a matrix (letters that it lacks count as its ``*``), or
    ``match`` for equal letters other than X and * and ``mismatch`` for all others."""
    table = np.full((256, 256), mismatch, np.int32)
    if rows:
        given = {(a.upper(), b.upper()): s for a, b, s in rows}
        letters = {a for a, _ in given}
        least = min(given.values())
        known = lambda c: c if c in letters else "*"
        for a in range(33, 127):
            for b in range(33, 127):
                table[a, b] = given.get((known(chr(a).upper()), known(chr(b).upper())), least)
    else:
        for c in "ABCDEFGHIJKLMNOPQRSTUVWYZ":
            table[ord(c), ord(c)] = match
    table[0, :] = table[:, 0] = FAR
    return table


def codons(dna: str) -> np.ndarray:
    """The amino acid, as a letter's code, of the codon that starts at each base."""
    b = BASE_CODE[np.frombuffer(dna.encode(), np.uint8)].astype(np.int64)
    code = b[:-2] * 16 + b[1:-1] * 4 + b[2:] if len(b) > 2 else np.empty(0, np.int64)
    return np.where(code < 64, CODON_TABLE[np.minimum(code, 63)], ord("X")).astype(np.uint8)


def padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All arrays behind each other with a 0 around each, and where each starts and stops."""
    size = np.array([len(p) for p in parts], np.int64)
    start = np.cumsum(np.concatenate(([1], size[:-1] + 1)))
    flat = np.zeros(int(size.sum()) + len(parts) + 1, np.uint8)
    for p, s in zip(parts, start.tolist(), strict=True):
        flat[s : s + len(p)] = p
    return flat, start, start + size


class Batch:
    """Reads' strands and proteins of some chains, and how they are aligned.  ``of``: the strand and the protein of
    each chain; without it, chain by chain its own."""

    def __init__(self, dna: list[str], proteins: list[str], table: np.ndarray, gap_open: int, gap_extend: int, shift: int | None, x_drop: int, band: int = BAND, of: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.aa, self.a_lo, self.a_hi = padded([codons(x) for x in dna])
        self.prot, self.p_lo, self.p_hi = padded([np.frombuffer(p.upper().encode(), np.uint8) for p in proteins])
        self.table, self.open, self.extend, self.shift, self.x_drop = table, gap_open, gap_extend, shift, x_drop
        self.side = -(-band // 3) * 3
        self.width = 2 * self.side + 3
        scores = table[1:128, 1:128]
        most = x_drop + gap_open + gap_extend * self.width + (shift or 0) + int(np.abs(scores).max())
        self.short = most <= MOST_SHORT
        if self.short:
            self.prepared()
        if of:
            self.a_lo, self.a_hi, self.p_lo, self.p_hi = self.a_lo[of[0]], self.a_hi[of[0]], self.p_lo[of[1]], self.p_hi[of[1]]
            if self.short:
                self.s_lo, self.s_hi = self.s_lo[of[0]], self.s_hi[of[0]]

    def prepared(self) -> None:
        """What :meth:`best` reads: codons with zeros around each strand, in both directions, and scores of 16 bits."""
        room = np.zeros(self.width + 3 * ROWS, np.uint8)
        size = self.a_hi - self.a_lo
        self.s_lo = np.cumsum(size + len(room)) - size
        parts = [x for lo, hi in zip(self.a_lo.tolist(), self.a_hi.tolist(), strict=True) for x in (room, self.aa[lo:hi])]
        self.ahead = np.concatenate([*parts, room])
        self.back = self.ahead[::-1].copy()
        self.s_hi = self.s_lo + size
        self.scores = self.table.astype(np.int32).clip(FAR_SHORT).astype(np.int16)
        # scores of one number for equal letters and one for others are compared, not looked up
        letters = np.arange(1, 128)
        inner, diagonal = self.table[1:128, 1:128], self.table[letters, letters]
        high, low = int(diagonal.max()), int(inner.min())
        self.two = (high, low) if (inner[~np.eye(127, dtype=bool)] == low).all() and np.isin(diagonal, (high, low)).all() and max(self.aa.max(), self.prot.max(initial=0)) < 128 else None
        if self.two:
            alone = np.flatnonzero(diagonal == low) + 1
            mine, theirs = np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
            mine[alone], theirs[alone] = 129, 128
            self.prot_codes, self.ahead = theirs[self.prot], mine[self.ahead]
            self.back = self.ahead[::-1].copy()

    def best(self, who: np.ndarray, q: np.ndarray, r: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, amino acids, bases) as :meth:`reach` has them.

        Rows are held in 16 bits, as distances from each chain's best score, one behind the other with FAR_SHORT
        between them, so that a step to other cells is one step for all chains.
        """
        if not self.short:
            return self.reach(who, q, r, sign)
        n, w, c, e = len(who), self.width, self.side, np.int16(self.extend)
        wide, drop, opening = w + 3, np.int16(-self.x_drop), np.int16(self.open)
        best, best_i, best_o = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, c)
        row = np.full((n, wide), FAR_SHORT, np.int16)
        row[:, c] = 0
        first = np.arange(1, (w - c - 1) // 3 + 1)
        row[:, c + 3 * first] = -self.open - first * self.extend
        down = np.full((n, wide), FAR_SHORT, np.int16)
        climb = np.zeros(wide, np.int16)
        climb[:w] = np.arange(w) // 3 * self.extend
        rise = climb[None, :]
        fall = (climb + opening + e)[None, :]
        # a run that costs more than the drop ends under it
        reach = min(w, 3 * (max(self.x_drop - self.open, 0) // max(self.extend, 1) + 2))
        views = np.lib.stride_tricks.sliding_window_view(self.ahead if sign > 0 else self.back, w)
        total = len(self.ahead)
        live, i = np.arange(n), 0
        while len(live):
            i += 1
            chain = who[live]
            at = self.p_lo[chain] + (r[live] + i - 1 if sign > 0 else r[live] - i)
            inside = (at >= self.p_lo[chain]) & (at < self.p_hi[chain])
            if not inside.all():
                live, chain, at, row, down = live[inside], chain[inside], at[inside], row[inside], down[inside]
                if not len(live):
                    break
            m = len(live)
            lo, hi = self.s_lo[chain], self.s_hi[chain]
            if sign > 0:
                start = np.clip(lo + q[live] + 3 * i - c - 3, lo - w, hi)
            else:
                start = np.clip(total - 1 - (lo + q[live] - 3 * i + c), total - hi - w, total - lo)
            codes = views[start]
            pair = np.full((m, wide), FAR_SHORT, np.int16)
            if self.two:
                high, low = self.two
                pair[:, :w] = codes == self.prot_codes[at][:, None]
                pair[:, :w] *= np.int16(high - low)
                pair[:, :w] += np.int16(low)
                if not codes.all():
                    pair[:, :w][codes == 0] = FAR_SHORT
            else:
                pair[:, :w] = self.scores[self.prot[at][:, None], codes]
            if 3 * i - c < 3:
                pair[:, : 3 - 3 * i + c] = FAR_SHORT
            flat, deep = row.ravel(), down.ravel()
            here = flat
            if self.shift:
                # the cells on both sides, past the ends of rows FAR_SHORT
                beside = np.empty_like(flat)
                beside[0], beside[-1] = flat[1], flat[-2]
                np.maximum(flat[2:], flat[:-2], out=beside[1:-1])
                beside -= np.int16(self.shift)
                here = np.maximum(flat, beside, out=beside)
            here = np.add(here, pair.ravel(), out=pair.ravel())
            under = np.full_like(flat, FAR_SHORT)
            np.maximum(flat[3:] - opening, deep[3:], out=under[:-3])
            under[:-3] -= e
            np.maximum(here, under, out=here)
            here, under = here.reshape(m, wide), under.reshape(m, wide)
            here[:, w:] = under[:, w:] = FAR_SHORT
            # runs of codons without amino acids: a running maximum by doubled steps, in each of the three frames
            top, spare, step = here + rise, np.empty_like(here), 3
            while step < reach:
                spare[:, :step] = top[:, :step]
                np.maximum(top[:, step:], top[:, :-step], out=spare[:, step:])
                top, spare, step = spare, top, 2 * step
            top -= fall
            np.maximum(here[:, 3:], top[:, :-3], out=here[:, 3:])
            here[:, w:] = FAR_SHORT
            row, down = here, under
            value = row.max(axis=1)
            more = np.flatnonzero(value > 0)
            if len(more):
                best[live[more]] += value[more]
                best_i[live[more]], best_o[live[more]] = i, row[more].argmax(axis=1)
                row[more] -= value[more, None]
                down[more] -= value[more, None]
            # FAR_SHORT where a cell lies under the drop: its sign, as a mask
            below = np.subtract(row, drop, out=spare)
            below >>= 15
            below &= np.int16(FAR_SHORT)
            row += below
            np.maximum(row, np.int16(FAR_SHORT), out=row)
            stay = value >= drop
            if not stay.all():
                live, row, down = live[stay], row[stay], down[stay]
        return best, best_i, 3 * best_i + best_o - c

    def bounded(self) -> bool:
        """Whether :meth:`most` can tell: scores of one number for equal letters and one for others, in small values."""
        if not (self.short and self.two):
            return False
        high, low = self.two
        gain, costs = high - max(low, -self.extend), self.open + self.extend + 2 * (self.shift or 0)
        return high > 0 > low and min(self.open, self.extend, self.shift or 0) >= 0 and costs + (RESTART + 2) * gain < 128

    def most(self, who: np.ndarray, q: np.ndarray, r: np.ndarray, sign: int, enough: np.ndarray) -> np.ndarray:
        """No less than the scores of :meth:`best`, or than ``enough`` of each.

        An easier program: a gap costs its least, however long it is, and so does what leads to another frame but
        the step to the next base.  So a row only needs the largest value of each frame.  Values count from the score
        of a row of other letters; by frame, codon and chain, a step to other cells is one of the same bytes.
        """
        high, low = self.two
        low = max(low, -self.extend)
        gap, down, gain, frames = self.open + self.extend, self.open, np.int8(high - low), 3 if self.shift else 1
        turn = gap + self.shift if self.shift else 0
        k, c = self.width // 3, self.side // 3
        views = np.lib.stride_tricks.sliding_window_view(self.ahead if sign > 0 else self.back, 3 * (ROWS + k - 1))
        out = np.zeros(len(who), np.int64)
        rows = self.p_hi[who] - self.p_lo[who] - r if sign > 0 else r
        # of much alike numbers of rows together
        order = np.argsort(rows, kind="stable")
        for part in range(0, len(order), BOUNDED):
            live = order[part : part + BOUNDED]
            best, base = np.zeros(len(live), np.int32), np.zeros(len(live), np.int32)
            value = np.full((frames, k, len(live)), -(turn or gap), np.int8)
            value[0, c] = 0
            before = None
            for begin in range(0, int(rows[live].max(initial=0)), ROWS):
                chain = who[live]
                lo, hi = self.s_lo[chain], self.s_hi[chain]
                if sign > 0:
                    start = np.clip(lo + q[live] - self.side + 3 * begin, lo - self.width, hi)
                else:
                    start = np.clip(len(self.ahead) + 2 - lo - q[live] - self.side + 3 * begin, len(self.ahead) - hi - self.width, len(self.ahead) - lo)
                codes = np.ascontiguousarray(views[start].reshape(len(live), ROWS + k - 1, 3)[:, :, :frames].transpose(2, 1, 0))
                step = np.arange(begin, begin + ROWS)[:, None]
                at = self.p_lo[chain] + (r[live] + step if sign > 0 else r[live] - 1 - step)
                letters = np.where(step < rows[live], self.prot_codes[np.clip(at, 0, len(self.prot_codes) - 1)], np.uint8(NONE))
                for i in range(min(ROWS, int(rows[live].max()) - begin)):
                    top = value.max(axis=1)
                    if self.shift:
                        all_top = top.max(axis=0)
                        floor = np.maximum(top - np.int8(gap), (all_top - np.int8(turn))[None])
                        if before is not None:
                            np.maximum(floor, before - np.int8(down), out=floor)
                            np.maximum(floor, before.max(axis=0) - np.int8(down + self.shift), out=floor)
                    else:
                        all_top = top[0]
                        floor = top - np.int8(gap)
                        if before is not None:
                            np.maximum(floor, before - np.int8(down), out=floor)
                    before = top
                    # no codon lies before the seed
                    first = max(c - begin - i, 0)
                    if self.shift:
                        beside = np.empty_like(value)
                        np.maximum(value[0], value[2], out=beside[1])
                        beside[0, 0] = value[1, 0]
                        np.maximum(value[1, 1:], value[2, :-1], out=beside[0, 1:])
                        beside[2, -1] = value[1, -1]
                        np.maximum(value[1, :-1], value[0, 1:], out=beside[2, :-1])
                        beside -= np.int8(self.shift)
                        np.maximum(value, beside, out=value)
                    np.maximum(value, floor[:, None], out=value)
                    same = codes[:, i + first : i + k] == letters[i]
                    inc = same.view(np.int8)
                    inc *= gain
                    value[:, first:] += inc
                    now = value.max(axis=(0, 1))
                    np.maximum(best, base + now + low * (begin + i + 1), out=best)
                    if (i + 1) % RESTART == 0:
                        value -= now
                        before = before - now
                        base += now
                on = (best < enough[live]) & (rows[live] > begin + ROWS)
                out[live] = best
                if not on.all():
                    live, best, base, value, before = live[on], best[on], base[on], np.ascontiguousarray(value[:, :, on]), before[:, on]
                if not len(live):
                    break
        return out

    def reach(self, who: np.ndarray, q: np.ndarray, r: np.ndarray, sign: int, until: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(score, amino acids, bases[, ops]) of the best extension of chains ``who`` from base ``q`` and
        amino acid ``r``, to the right (``sign`` 1) or to the left (-1); with ops if ``until``, the amino
        acids of the best extensions, are known."""
        traced = until is not None
        n, w, c, e = len(who), self.width, self.side, self.extend
        best, best_i, best_o = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, c)
        row = np.full((n, w), FAR, np.int32)
        row[:, c] = 0
        first = np.arange(1, (w - c - 1) // 3 + 1)
        row[:, c + 3 * first] = -self.open - first * e
        down = np.full((n, w), FAR, np.int32)
        climb = (np.arange(w // 3) * e).astype(np.int32)[:, None]
        live, i, trail = np.arange(n), 0, []
        place = np.arange(w)
        while len(live):
            i += 1
            at = self.p_lo[who[live]] + (r[live] + i - 1 if sign > 0 else r[live] - i)
            inside = (at >= self.p_lo[who[live]]) & (at < self.p_hi[who[live]])
            if traced:
                inside &= i <= until[live]
            if not inside.all():
                live, at, row, down = live[inside], at[inside], row[inside], down[inside]
                if not len(live):
                    break
            bases = 3 * i + place - c
            lo, hi = self.a_lo[who[live], None], self.a_hi[who[live], None]
            start = lo + q[live, None] + (bases - 3 if sign > 0 else -bases)
            pair = self.table[self.prot[at][:, None], self.aa[np.clip(start, lo - 1, hi)]]
            if 3 * i - c < 3:
                pair[:, bases < 3] = FAR
            move = np.zeros(row.shape, np.uint8) if traced else None
            here = row + pair
            if traced:
                move[:] = PAIR
            if self.shift:
                for step, kind in ((1, TWICE), (-1, SKIP)):
                    other = np.full_like(row, FAR)
                    if step > 0:
                        other[:, :-1] = row[:, 1:]
                    else:
                        other[:, 1:] = row[:, :-1]
                    other += pair - np.int32(self.shift)
                    if traced:
                        move[other > here] = kind
                    np.maximum(here, other, out=here)
            opened, on = np.full_like(row, FAR), np.full_like(row, FAR)
            opened[:, :-3], on[:, :-3] = row[:, 3:] - self.open - e, down[:, 3:] - e
            down = np.maximum(opened, on)
            if traced:
                move[down > here] = DOWN
                move[on > opened] |= DOWN_ON
            np.maximum(here, down, out=here)
            # runs of codons without amino acids: a running maximum in each of the three frames
            top = np.maximum.accumulate(here.reshape(len(live), -1, 3) + climb, axis=1)
            right = np.full_like(row, FAR)
            right[:, 3:] = (top[:, :-1] - climb[1:] - self.open).reshape(len(live), -1)
            if traced:
                move[right > here] |= RIGHT
                further = np.zeros(row.shape, bool)
                further[:, 6:] = right[:, 3:-3] - e > here[:, 3:-3] - self.open - e
                move[further] |= RIGHT_ON
                full = np.zeros((n, w), np.uint8)
                full[live] = move
                trail.append(full)
            row = np.maximum(here, right)
            np.maximum(row, FAR, out=row)
            peak = row.argmax(axis=1)
            value = row[np.arange(len(live)), peak]
            more = value > best[live]
            best[live[more]], best_i[live[more]], best_o[live[more]] = value[more], i, peak[more]
            stay = value >= best[live] - self.x_drop
            row[row < (best[live] - self.x_drop)[:, None]] = FAR
            if not stay.all():
                live, row, down = live[stay], row[stay], down[stay]
        out = (best, best_i, 3 * best_i + best_o - c)
        if not traced:
            return out
        return (*out, [self.path(trail, k, int(i_), int(o), sign) for k, (i_, o) in enumerate(zip(best_i, best_o, strict=True))])

    def path(self, trail: list[np.ndarray], k: int, i: int, o: int, sign: int) -> str:
        """The ops of chain ``k`` from its best cell back to the seed, from left to right."""
        ops, state = [], "best"
        while i > 0:
            move = int(trail[i - 1][k, o])
            if state == "best" and move & RIGHT:
                state = "right"
            if state == "right":
                ops.append("I")
                state = "right" if move & RIGHT_ON else "here"
                o -= 3
                continue
            kind = DOWN if state == "down" else move & 7
            if kind == DOWN:
                ops.append("D")
                state = "down" if move & DOWN_ON else "best"
                i, o = i - 1, o + 3
                continue
            ops.append("M")
            if kind != PAIR:
                ops.append("/" if kind == TWICE else "\\")
            i, o, state = i - 1, o + (kind == TWICE) - (kind == SKIP), "best"
        ops += ["I"] * ((o - self.side) // 3)
        return "".join(ops if sign < 0 else reversed(ops))


def aligned(batch: Batch, seeds: list[list[tuple[int, int]]], least: np.ndarray) -> list[tuple[int, int, int, int, int, int, str]]:
    """(chain, score, q_start, q_stop, r_start, r_stop, ops): from each chain's first seed (base, amino
    acid), and from its next one that lies in no alignment yet, as long as there is one."""
    out = []
    hopeful = promising(batch, seeds, least) if batch.bounded() else np.ones(len(seeds), bool)
    left = {k: list(s) for k, s in enumerate(seeds) if s and hopeful[k]}
    while left:
        who = np.array(sorted(left))
        q, r = (np.array([left[k][0][x] for k in who.tolist()], np.int64) for x in (0, 1))
        parts = range(0, len(who), CHAINS)
        found = [tuple(np.concatenate(x) for x in zip(*(batch.best(who[p : p + CHAINS], q[p : p + CHAINS], r[p : p + CHAINS], sign) for p in parts), strict=True)) for sign in (-1, 1)]
        score = found[0][0] + found[1][0]
        box = np.stack([q - found[0][2], q + found[1][2], r - found[0][1], r + found[1][1]], axis=1)
        good = np.flatnonzero(score >= least[who])
        rows = 1 + int(max(f[1][good].max(initial=0) for f in found))
        step = max(1, MOVES // (rows * batch.width))
        for part in range(0, len(good), step):
            some = good[part : part + step]
            before, after = (batch.reach(who[some], q[some], r[some], sign, f[1][some])[3] for sign, f in zip((-1, 1), found, strict=True))
            out += [(int(who[k]), int(score[k]), *map(int, box[k]), a + b) for k, a, b in zip(some.tolist(), before, after, strict=True)]
        for k, (q0, q1, r0, r1) in zip(who.tolist(), box.tolist(), strict=True):
            left[k] = [(a, b) for a, b in left[k][1:] if not (q0 <= a < q1 and r0 <= b < r1)]
            if not left[k]:
                del left[k]
    return out


def promising(batch: Batch, seeds: list[list[tuple[int, int]]], least: np.ndarray) -> np.ndarray:
    """Whether any seed of a chain may lead to an alignment of its ``least`` score.  A chain of which none does is
    left out as a whole: what its alignments hold matters to its own seeds only."""
    who = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
    q, r = np.array([x for s in seeds for x in s], np.int64).reshape(-1, 2).T
    enough = np.maximum(least[who], 1)
    ahead = batch.most(who, q, r, 1, enough)
    both = ahead + batch.most(who, q, r, -1, enough - ahead)
    out = np.zeros(len(seeds), bool)
    out[who[both >= least[who]]] = True
    return out


def lines(dna: str, protein: str, q_start: int, r_start: int, ops: str, table: np.ndarray | None = None) -> tuple[str, str, str]:
    """Query, middle and subject line of an alignment; shifts stand in the query line.  The middle
    line holds equal letters, and + for others that score above 0 in ``table``."""
    q, mid, r, i, j = [], [], [], r_start, q_start
    for op in ops:
        if op in "/\\":
            j += 1 if op == "\\" else -1
            q.append(op), mid.append(" "), r.append("-")
        elif op == "M":
            a = CODONS.get(dna[j : j + 3], "X")
            positive = table is not None and table[ord(a), ord(protein[i])] > 0
            q.append(a), mid.append(a if a == protein[i] else "+" if positive else " "), r.append(protein[i])
            i, j = i + 1, j + 3
        elif op == "I":
            q.append(CODONS.get(dna[j : j + 3], "X")), mid.append(" "), r.append("-")
            j += 3
        else:
            q.append("-"), mid.append(" "), r.append(protein[i])
            i += 1
    return "".join(q), "".join(mid), "".join(r)


SCHEMA = (
    "doc_id long, prot_id long, strand string, score long, q_start long, q_stop long, r_start long, r_stop long, "
    "read_len long, ref_len long, ops string, query_line string, middle_line string, subject_line string"
)


def gapped_by_read(reads: DataFrame, table: np.ndarray, gap_open: int, gap_extend: int, shift: int | None, x_drop: int, band: int = BAND) -> DataFrame:
    """Alignments of reads (doc_id, dna, least, chains: array of (prot_id, strand, protein, seeds: array of (q, r))).

    As :func:`gapped`, but a read is sent and translated once for all of its chains in a row.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chains, letters = pc.list_value_length(batch.column(3)).to_numpy(), pc.binary_length(batch.column(1)).to_numpy()
            begin = n = size = 0
            for k, (c, x) in enumerate(zip(chains.tolist(), letters.tolist(), strict=True)):
                if k > begin and (n + c > PREPARED or size + x > PREPARED_LETTERS):
                    yield batch.slice(begin, k - begin)
                    begin, n, size = k, 0, 0
                n, size = n + c, size + x
            if batch.num_rows > begin:
                yield batch.slice(begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = pa.schema([(c, {"long": pa.int64(), "string": pa.string()}[t]) for c, t in (f.split() for f in SCHEMA.split(", "))])
        for some in pieces(batches):
            doc, dna, least = some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2).to_numpy()
            lists = some.column(3)
            read = pc.list_parent_indices(lists).to_numpy()
            prot, strand, protein, seeds = lists.flatten().flatten()
            minus = pc.equal(strand, "-").to_numpy(zero_copy_only=False)
            strands, own = np.unique(read * 2 + minus, return_inverse=True)
            texts = [dna[k >> 1] if not k & 1 else dna[k >> 1][::-1].translate(COMPLEMENT) for k in strands.tolist()]
            coded = protein.dictionary_encode()
            subjects, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            places = list(zip(*(x.to_pylist() for x in seeds.flatten().flatten()), strict=True))
            ends = np.cumsum(pc.list_value_length(seeds).to_numpy()).tolist()
            batch = Batch(texts, subjects, table, gap_open, gap_extend, shift, x_drop, band, (own, which))
            rows = []
            prots = prot.to_pylist()
            for k, score, q0, q1, r0, r1, ops in aligned(batch, [places[a:b] for a, b in zip([0, *ends], ends, strict=False)], least[read]):
                text, subject = texts[own[k]], subjects[which[k]]
                rows.append((doc[read[k]], prots[k], "-" if minus[k] else "+", score, q0, q1, r0, r1, len(text), len(subject), ops, *lines(text, subject, q0, r0, ops, table)))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.field(c).type) for c in range(len(names))], schema=kinds)

    return reads.select("doc_id", "dna", "least", "chains").mapInArrow(run, SCHEMA)


def gapped(chains: DataFrame, table: np.ndarray, gap_open: int, gap_extend: int, shift: int | None, x_drop: int, band: int = BAND) -> DataFrame:
    """Alignments of chains (doc_id, prot_id, strand, dna, protein, seeds: array of (q, r), least).

    ``dna`` is the read's strand, ``least`` the raw score from which an alignment counts.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for part in range(0, len(frame), CHAINS):
                some = frame.iloc[part : part + CHAINS]
                dna, proteins = some["dna"].tolist(), some["protein"].tolist()
                batch = Batch(dna, proteins, table, gap_open, gap_extend, shift, x_drop, band)
                seeds = [[(int(s["q"]), int(s["r"])) for s in chain] for chain in some["seeds"]]
                keys = some[["doc_id", "prot_id", "strand"]].values.tolist()
                for k, score, q0, q1, r0, r1, ops in aligned(batch, seeds, some["least"].to_numpy()):
                    rows.append((*keys[k], score, q0, q1, r0, r1, len(dna[k]), len(proteins[k]), ops, *lines(dna[k], proteins[k], q0, r0, ops, table)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return chains.select("doc_id", "prot_id", "strand", "dna", "protein", "seeds", "least").mapInPandas(run, SCHEMA)


def encoded(ops: str = "ops") -> str:
    """SQL of an edit script as runs, such as 12M1I3M."""
    runs = rf"regexp_extract_all({ops}, '((.)\\2*)', 1)"
    return f"array_join(transform({runs}, x -> concat(CAST(length(x) AS STRING), substr(x, 1, 1))), '')"


def statistics(found: DataFrame) -> DataFrame:
    """Adds the counts of an alignment's columns, from its lines."""
    zipped = "zip_with(split(query_line, ''), split(subject_line, ''), (a, b) -> struct(a AS a, b AS b))"
    n = lambda cond: F.expr(f"CAST(size(filter({zipped}, x -> {cond})) AS BIGINT)")
    shift = r"x.a IN ('/', '\\')"
    out = found.withColumns(
        {
            "length": n(f"NOT {shift}"),
            "nident": n("x.a = x.b"),
            "mismatch": n(f"x.a <> x.b AND x.a <> '-' AND x.b <> '-' AND NOT {shift}"),
            "gaps": n(f"(x.a = '-' OR x.b = '-') AND NOT {shift}"),
            "gapopen": F.expr(r"CAST(size(regexp_extract_all(regexp_replace(ops, '[/\\\\]', ''), 'I+|D+', 0)) AS BIGINT)"),
            "frameshifts": n(shift),
            # equal letters and those that score above 0
            "npos": F.expr("CAST(length(replace(middle_line, ' ', '')) AS BIGINT)"),
        }
    )
    share = lambda c: F.round(100 * F.col(c) / F.greatest("length", F.lit(1)), 2)
    return out.withColumns({"pident": share("nident"), "ppos": share("npos"), "pgaps": share("gaps")})
