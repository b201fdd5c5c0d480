"""Whether an extension or an alignment is worth its whole length: folds with running extremes, as expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ*"


def optimal_extension(steps: Column, drop: int) -> Column:
    """Whether no prefix of the scores ``steps`` of an ungapped extension sums to 0 or less, none lies
    more than ``drop`` under the best before it, and the last is the best of all."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("best"), F.lit(True).alias("ok"))

    def step(s: Column, x: Column) -> Column:
        total = s["total"] + x
        fine = (total > s["best"]) | ((total >= s["best"] - drop) & (total > 0))
        return F.struct(total.alias("total"), F.greatest(s["best"], total).alias("best"), (s["ok"] & fine).alias("ok"))

    return F.aggregate(steps, start, step, lambda s: s["ok"] & (s["total"] == s["best"]) & (s["total"] > 0))


def optimal_alignment(steps: Column, drop: int) -> Column:
    """Whether the score of an alignment, along its columns' ``steps``, never lies more than ``drop`` under its best so far."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("best"), F.lit(True).alias("ok"))

    def step(s: Column, x: Column) -> Column:
        best = F.greatest(s["best"], s["total"] + x)
        return F.struct((s["total"] + x).alias("total"), best.alias("best"), (s["ok"] & (s["total"] + x >= best - drop)).alias("ok"))

    return F.aggregate(steps, start, step, lambda s: s["ok"])


def pair_scores(table: np.ndarray) -> Column:
    """A map of two letters to their score in ``table``, which goes by the letters' codes."""
    return F.create_map(*(F.lit(x) for a in LETTERS for b in LETTERS for x in (a + b, int(table[ord(a), ord(b)]))))


def alignment_steps(table: np.ndarray, gap_open: int, gap_extend: int, shift: int | None, query: str = "query_line", subject: str = "subject_line") -> Column:
    """The scores of an alignment's columns, from its lines; a gap's first column pays for its opening too."""
    columns = F.zip_with(F.split(query, ""), F.split(subject, ""), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    gap = lambda x: (x["a"] == "-") | ((x["b"] == "-") & ~x["a"].isin("/", "\\"))
    # a gap goes on if the column before is one of the same kind
    before = lambda xs, k, x: (k > 0) & gap(F.get(xs, k - 1)) & ((F.get(xs, k - 1)["a"] == "-") == (x["a"] == "-"))
    scores = pair_scores(table)
    step = lambda xs: F.transform(xs, lambda x, k: F.when(x["a"].isin("/", "\\"), F.lit(-(shift or 0))).when(gap(x), F.when(before(xs, k, x), F.lit(-gap_extend)).otherwise(F.lit(-gap_open - gap_extend))).otherwise(F.element_at(scores, F.concat(x["a"], x["b"]))))
    return step(F.filter(columns, lambda x: x["a"] != ""))


def optimal(found: DataFrame, table: np.ndarray, gap_open: int, gap_extend: int, shift: int | None, drop: int) -> DataFrame:
    """The alignments that never fall more than ``drop`` under their best."""
    return found.filter(optimal_alignment(alignment_steps(table, gap_open, gap_extend, shift), drop))
