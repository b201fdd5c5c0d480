"""A quality score by a generalised additive model with pairwise interactions.

Features of whole texts are binned; cyclic boosting of shallow trees, feature after
feature, learns one lookup table per feature, then tables for the strongest pairs.  A
score is the sum of table entries of a text's bins, through the logistic function.

Training uses at most ``sample_rows`` labelled rows (those with the smallest hashes of
doc_id), whose features, not texts, reach the driver.  Scoring is one Arrow pass over all
documents.  Defined results: null texts score as empty ones; unlabelled or unlearnable
inputs (no labels, one class) give the share of label 1, or 0.5; repeated rows score
alike; of a labelled doc_id on several rows one text is taught, that with the smallest hash; of
repeated labels the smallest counts; rows alike in all features tie and share a score; a text of
any length is read whole, by one task; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .minhash import mixed, word_hashes

FEATURES = [
    "log_bytes", "log_words", "mean_word", "upper", "digits", "symbols", "bars", "marks", "stops", "non_ascii",
    "lines_per_word", "distinct_words", "same_as_last", "top_word", "distinct_windows", "distinct_lines", "longest_word",
]


def features(text: str | None) -> list[float]:
    """The numbers of FEATURES for one whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(len(data), 1)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    of = lambda chars: float(count[np.frombuffer(chars, np.uint8)].sum())
    upper, lower = count[65:91].sum(), count[97:123].sum()
    w = word_hashes(data.lower())
    words = max(len(w), 1)
    values, times = np.unique(w, return_counts=True)
    windows = 1.0
    if len(w) >= 5:
        h = np.zeros(len(w) - 4, np.uint64)
        for k in range(5):
            h = mixed(h + w[k : len(w) - 4 + k])
        windows = len(np.unique(h)) / len(h)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        float(np.log1p(len(data))), float(np.log1p(len(w))), float(n - of(b" \n")) / words, upper / max(upper + lower, 1),
        float(count[48:58].sum()) / n, of(b"#*$%&<>~^{}") / n, of(b"|") / n, of(b"!?") / n, of(b".") / words, float(count[128:].sum()) / n,
        len(lines) / words, len(values) / words, float((w[1:] == w[:-1]).sum()) / words, float(times.max(initial=0)) / words, windows,
        len(set(lines)) / max(len(lines), 1), float(max(map(len, data.split()), default=0)),
    ]


@dataclass
class Gam:
    """Bin edges per feature, a table per feature, and tables of feature pairs over coarse bins."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(x), 0), int)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        fine = self.bins(x, self.edges)
        for j, table in enumerate(self.tables):
            out += table[fine[:, j]]
        if self.pairs:
            rough = self.bins(x, self.coarse)
            for (i, j), table in self.pairs.items():
                out += table[rough[:, i], rough[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The gain and the place of the best cut of ordered bins; gain 0 if there is none."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int) -> np.ndarray:
    """A value per bin from a tree of ``depth`` cuts on the way to a leaf."""
    gain, k = best_cut(g, h, ridge) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate([shallow_tree(g[:k], h[:k], ridge, depth - 1), shallow_tree(g[k:], h[k:], ridge, depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """One cut along the first axis and then one in each part along the second, and its gain."""
    best, value = 0.0, np.zeros_like(g)
    for k in range(1, len(g)):
        gain, parts = 0.0, []
        for part_g, part_h in ((g[:k], h[:k]), (g[k:], h[k:])):
            leaf = shallow_tree(part_g.sum(0), part_h.sum(0), ridge, 1)
            gain += float((2 * leaf * part_g.sum(0) - leaf**2 * (part_h.sum(0) + ridge / len(leaf))).sum())
            parts.append(np.repeat(leaf[None], len(part_g), 0))
        if gain > best:
            best, value = gain, np.concatenate(parts)
    return best, value


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, ridge: float = 5.0, n_pairs: int = 6, pair_rounds: int = 40) -> Gam:
    """Tables for features and pairs from ``x`` and labels 0 and 1."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Gam(base=float(np.log(share / (1 - share))))
    share = y.mean()
    cuts = lambda k: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, k + 1)[1:-1])) for j in range(x.shape[1])]
    model = Gam(float(np.log(share / (1 - share))), cuts(48), [], cuts(8))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    fine, rough = model.bins(x, model.edges), model.bins(x, model.coarse)
    logits = np.full(len(y), model.base)
    sums = lambda b, size, v: np.bincount(b, weights=v, minlength=size)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * shallow_tree(sums(fine[:, j], len(table), g), sums(fine[:, j], len(table), h), ridge, 2)
            table += step
            logits += step[fine[:, j]]
    sizes = [len(e) + 1 for e in model.coarse]

    def grid(i: int, j: int) -> tuple[float, np.ndarray]:
        g, h = slopes()
        cell, size = rough[:, i] * sizes[j] + rough[:, j], sizes[i] * sizes[j]
        return pair_tree(sums(cell, size, g).reshape(sizes[i], -1), sums(cell, size, h).reshape(sizes[i], -1), ridge)

    every = [(i, j) for i in range(len(sizes)) for j in range(i + 1, len(sizes)) if min(sizes[i], sizes[j]) > 1]
    strongest = sorted(every, key=lambda ij: -grid(*ij)[0])[:n_pairs]
    model.pairs = {ij: np.zeros((sizes[ij[0]], sizes[ij[1]])) for ij in strongest}
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            step = rate * grid(i, j)[1]
            table += step
            logits += step[rough[:, i], rough[:, j]]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def with_features(docs: DataFrame, extra: str) -> DataFrame:
    """``extra`` columns (one, of longs) and ``x``, the features of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=[extra, "x"])

    return docs.select(F.col(extra).cast("long"), "text").mapInArrow(run, f"{extra} long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Gam:
    """A model from a bounded sample of the labelled rows that are not held out."""
    taught = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    taught = taught.groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality"))
    sample = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).withColumnRenamed("doc_id", "_id")
    both = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    # a doc_id may stand on any number of rows: one of its texts is taught, so no more than ``sample_rows`` are gathered
    one = both.groupBy("_id").agg(F.first("quality").alias("quality"), F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), "text")).alias("t"))
    rows = sorted(with_features(one.select("quality", "t.text"), "quality").collect(), key=lambda r: (r["quality"], r["x"]))
    return fit(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["quality"] for r in rows], float))


def scored(docs: DataFrame, model: Gam, cut: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
