"""Scores of residue pairs and Karlin-Altschul statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Matrix, gap opening, gap extension, lambda, K, H.
KARLIN_ALTSCHUL = [
    ("BLOSUM80", 11, 2, 0.365249, 0.168504, 0.350),
    ("BLOSUM80", 25, 2, 0.342, 0.170, 0.660),
    ("BLOSUM80", 13, 2, 0.336, 0.150, 0.570),
    ("BLOSUM80", 9, 2, 0.319, 0.110, 0.420),
    ("BLOSUM80", 8, 2, 0.308, 0.090, 0.350),
    ("BLOSUM80", 7, 2, 0.293, 0.070, 0.270),
    ("BLOSUM80", 6, 2, 0.268, 0.045, 0.190),
    ("BLOSUM80", 11, 1, 0.314, 0.095, 0.350),
    ("BLOSUM80", 10, 1, 0.299, 0.071, 0.270),
    ("BLOSUM80", 9, 1, 0.279, 0.048, 0.200),
    ("BLOSUM62", 11, 1, 0.267, 0.041, 0.140),
    ("BLOSUM62", 11, 2, 0.297, 0.082, 0.270),
    ("BLOSUM62", 10, 2, 0.291, 0.075, 0.230),
    ("BLOSUM62", 9, 2, 0.279, 0.058, 0.190),
]
#: Fixed value: the expectation threshold of a seed.
SEED_EXPECTATION = 1.52718


def ka_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KARLIN_ALTSCHUL, "matrix string, gap_open int, gap_extend int, lambda double, k double, h double")


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """The columns of :func:`ka_table` from a text file: a row of matrix, gap opening, gap extension, lambda, K
    and H, parted by blanks, for each choice of penalties; other lines do not count."""
    f = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).filter("size(f) = 6 AND f[1] RLIKE '^[0-9]+$'")
    return f.selectExpr("f[0] AS matrix", "int(f[1]) AS gap_open", "int(f[2]) AS gap_extend", "double(f[3]) AS lambda", "double(f[4]) AS k", "double(f[5]) AS h")


def ka(matrix: str, gap_open: int, gap_extend: int, rows: list[tuple] = KARLIN_ALTSCHUL) -> tuple[float, float, float]:
    """(lambda, K, H) from the built-in ``rows`` or others; unknown penalties are an error."""
    for m, o, e, *values in rows:
        if (m, o, e) == (matrix, gap_open, gap_extend):
            return tuple(values)
    raise ValueError(f"no statistics for {matrix} with {gap_open}/{gap_extend}")


def known_rows(spark: SparkSession, path: str | None) -> list[tuple]:
    """The built-in statistics, after those of a file (a row for each choice of penalties of a few matrices)."""
    return [*([tuple(r) for r in read_statistics(spark, path).collect()] if path else []), *KARLIN_ALTSCHUL]


#: How often each amino acid stands in proteins, per thousand.
BACKGROUND = {
    "A": 78, "R": 51, "N": 45, "D": 54, "C": 19, "Q": 43, "E": 63, "G": 74, "H": 22, "I": 51,
    "L": 91, "K": 57, "M": 22, "F": 39, "P": 52, "S": 71, "T": 58, "W": 13, "Y": 32, "V": 64,
}


def ungapped(scores: np.ndarray, background: dict[str, int] = BACKGROUND, terms: int = 60) -> tuple[float, float, float]:
    """(lambda, K, H) of ungapped alignments under ``scores`` (by two letters' codes), by the theory of
    Karlin and Altschul: lambda solves sum p exp(lambda s) = 1; K by its series of sums of scores."""
    total, share = sum(background.values()), {}
    for a, n in background.items():
        for b, m in background.items():
            s = int(scores[ord(a), ord(b)])
            share[s] = share.get(s, 0.0) + n * m / total**2
    low, high = min(share), max(share)
    p = np.array([share.get(s, 0.0) for s in range(low, high + 1)])
    s = np.arange(low, high + 1)
    if high <= 0 or (p * s).sum() >= 0:
        raise ValueError("scores need a positive one and a negative mean")
    left, right = 0.0, 1.0
    while (p * np.exp(right * s)).sum() < 1:
        right *= 2
    for _ in range(100):
        mid = (left + right) / 2
        left, right = (mid, right) if (p * np.exp(mid * s)).sum() < 1 else (left, mid)
    lam = (left + right) / 2
    h = lam * (p * s * np.exp(lam * s)).sum()
    step = math.gcd(*(int(x) for x in s[p > 0]))
    sums, sigma = np.ones(1), 0.0
    for j in range(1, terms + 1):
        sums = np.convolve(sums, p)
        value = np.arange(j * low, j * high + 1)
        sigma += float((sums * np.where(value >= 0, 1.0, np.exp(lam * np.minimum(value, 0)))).sum()) / j
    k = lam * step * math.exp(-2 * sigma) / (h * (1 - math.exp(-lam * step)))
    return lam, k, h


def bit_score(score: Column, lam: float, k: float) -> Column:
    return (F.lit(lam) * score - F.lit(math.log(k))) / F.lit(math.log(2))


#: Letters of the fixed space in which results without a base are compared, on each side.
FIXED_SPACE = 1e9


def evalue_of_fixed_space(score: Column, lam: float, k: float) -> Column:
    """Expected hits of this score between two texts of FIXED_SPACE letters: the same for all reads and bases."""
    return F.lit(k) * F.lit(FIXED_SPACE) * F.lit(FIXED_SPACE) * F.exp(-F.lit(lam) * score)


def evalue(score: Column, length: Column, letters: Column, lam: float, k: float) -> Column:
    """Expected hits of this score for a query of ``length`` in a base of ``letters``."""
    return F.lit(k) * letters * length * F.exp(-F.lit(lam) * score)


def min_seed_score(length: Column, letters: Column, lam: float, k: float) -> Column:
    return F.round((F.log(length * letters * F.lit(k)) - F.lit(SEED_EXPECTATION)) / F.lit(lam)).cast("long")


def coverage(run: Column, whole: Column) -> Column:
    return F.floor(run / whole * 100)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, score) of a score matrix in the NCBI text format: a header of letters, then a row per
    letter.  Header and rows may go on over lines, letters may stand in /* */, and # lines do not count.

    A matrix has some 27 letters, so its text is read as one value.
    """
    text = spark.read.text(path, wholetext=True)
    bare = F.regexp_replace(F.regexp_replace("value", r"(?m)^\s*#.*$", ""), r"/\*|\*/|[{},;]", " ")
    cells = text.select(F.split(F.trim(F.regexp_replace(bare, r"\s+", " ")), " ").alias("c"))
    number = "x RLIKE '^-?[0-9]+$'"
    heads = cells.select(F.expr(f"slice(c, 1, array_position(transform(c, x -> {number}), true) - 2)").cast("array<string>").alias("letters"), "c")
    # the last letter before the first number starts the first row
    rows = heads.select("letters", F.expr(f"filter(slice(c, size(letters) + 1, size(c)), x -> {number})").alias("n"), F.expr(f"filter(slice(c, size(letters) + 1, size(c)), x -> NOT {number})").alias("names"))
    each = rows.select("letters", "names", F.posexplode("n").alias("k", "score"))
    return each.select(F.expr("names[CAST(k DIV size(letters) AS INT)]").alias("a"), F.expr("letters[k % size(letters)]").alias("b"), F.col("score").cast("int"))
