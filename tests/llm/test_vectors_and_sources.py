"""Hard negatives, divergence of sources and approximate neighbours against brute force, with odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import divergence, hard_negatives, hnsw, minhash, quality_gam

VECTORS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")
#: Rows that take no part, one with a null component, and shorter ones.
ODD = [(1, None, 1), (2, [0.5, None], 1), (3, [NAN, 1.0], 1), (4, [INF, 1.0], 1), (5, [0.5, 0.5], None), (None, [0.5, 0.5], 1), (6, [], 2), (7, [0.25], 2)]


def of_ids(rows):
    """The rows that take part in hard negatives: alike ones once."""
    good = [(i, tuple(v), lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return sorted({(i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, lab in good})


def mined_plainly(rows, every):
    rows = of_ids(rows)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for i, lab, v in rows:
        if i % every:
            continue
        found = sorted((-dot(v, w), j, other) for j, other, w in rows if j != i)
        for p, j in sorted({(-s, j) for s, j, other in [x for x in found if x[2] == lab][:5]}):
            best = [(s, n) for s, n, other in found if other != lab and 80 * p <= -100 * s <= 100 * p][:5]
            out |= {(i, j, k + 1, n, p, -s) for k, (s, n) in enumerate(best)}
    return out


@pytest.mark.parametrize("kind", ["random", "ties", "copies", "odd"])
def test_hard_negatives_are_those_of_brute_force(spark, kind):
    rng = random.Random(5)
    if kind == "random":
        rows = [(i, [rng.gauss(0, 1) + (i % 3 == d) for d in range(6)], i % 4) for i in range(900)]
    elif kind == "ties":
        rows = [(i, [rng.choice([-0.01, 0.0, 0.01, 1.0]) for _ in range(3)], rng.randrange(3)) for i in range(400)]
    elif kind == "copies":
        rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [rng.random() for _ in range(3)], rng.randrange(3)) for i in range(600)]
        rows += rows[:30] + [(10, [9.0, 9.0, 9.0], 1), (10, [9.0, 9.0, 9.0], 2)]
    else:
        rows = ODD + [(10 * i, [0.1 * i, -0.3, 0.7], i % 2) for i in range(12)] + [(50, [1e30, -1e30, 1e30], 1), (60, [1e30, 1e30, 1e30], 0)]
    every = 1 if kind == "odd" else 7
    docs = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("cell", "part", "block", "v", "ask", "score", "low")})
    out = hard_negatives.mined(hard_negatives.quantised(docs), F.col("vec_id") % every == 0, shard_rows=100, block_rows=40)
    got = [tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    if kind == "odd":  # numbers beyond a long end at its bounds there
        got = [r for r in got if abs(r[4]) < 1 << 62]
        want = {r for r in mined_plainly(rows, every) if abs(r[4]) < 1 << 62}
    else:
        want = mined_plainly(rows, every)
    assert len(got) == len(set(got)) and set(got) == want and (want or kind == "odd")


def test_trees_leave_out_siblings():
    rng = np.random.default_rng(1)
    x = np.rint(rng.normal(0, 4, (4000, 3)) + 300 * rng.integers(0, 4, (4000, 1))).astype(np.int64)
    tree = hard_negatives.Tree(x, np.arange(4000), rng.integers(0, 3, 4000), float((x**2).sum(1).max()))
    seen, plain = [], hard_negatives.scores
    hard_negatives.scores = lambda a, b: seen.append(a.shape[0] * b.shape[0]) or plain(a, b)
    try:
        q = x[:50]
        low = (q**2).sum(1) * 98 // 100
        best, ids = tree.search(q, np.arange(50), tree.labels[:50], np.full(50, False), low, (q**2).sum(1), 5)
    finally:
        hard_negatives.scores = plain
    assert sum(seen) < 0.6 * 50 * 4000
    for k in range(50):
        s = x @ q[k]
        fit = sorted((-s[j], j) for j in range(4000) if j != k and tree.labels[j] != tree.labels[k] and low[k] <= s[j] <= (q[k] ** 2).sum())[:5]
        assert [(-a, b) for a, b in fit] == [(int(a), int(b)) for a, b in zip(best[k], ids[k], strict=True) if b < 1 << 60]


def neighbours(rows, every, k):
    good = {(i, tuple(float(np.float32(x)) for x in v)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in good:
        if i % every == 0:
            far = lambda w: math.sqrt(sum((a - b) ** 2 for a, b in zip(v + (0.0,) * (len(w) - len(v)), w + (0.0,) * (len(v) - len(w)), strict=True)))  # noqa: B023, E731
            out[i] = sorted((far(w), j) for j, w in good if j != i)[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_neighbours_of_many_shards(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 24))
    x[1000:2300] = x[0] + 0.01 * rng.normal(size=(1300, 24))  # near copies, a third of all
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    docs = spark.createDataFrame(rows, VECTORS)
    got = found(hnsw.nearest(hnsw.index(docs, 10, shard_rows=900), docs.filter("vec_id % 40 = 0"), 10, block_rows=50))
    want = neighbours(rows, 40, 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = [len({j for _, j in got[i]} & {j for _, j in want[i]}) / 10 for i in want]
    assert sum(hits) / len(hits) >= 0.9
    for i in want:
        for s, j in got[i]:
            assert s == pytest.approx(math.dist(np.float32(x[i]).astype(float), np.float32(x[j]).astype(float)), rel=1e-12)


def test_neighbours_of_copies_and_odd_rows(spark):
    rows = ODD + [(i, [1.0, 2.0, 3.0], 0) for i in range(100, 160)] + [(i, [i / 7, 1.0, -1.0], 0) for i in range(200, 230)]
    rows += [(300, [0.0, 0.0, 0.0], 0), (100, [1.0, 2.0, 3.0], 1), (310, [3e38, 0.0, 1.0], 0), (320, [3e38, 0.0, 2.0], 0)]
    docs = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("v", "shard", "node", "ids", "links", "query_id", "h")})
    got, want = found(hnsw.search(docs, F.col("vec_id") % 10 == 0, 10)), neighbours(rows, 10, 10)
    assert set(got) == set(want)
    for i in want:
        assert [j for _, j in got[i]] == [j for _, j in want[i]]
        assert [s for s, _ in got[i]] == pytest.approx([s for s, _ in want[i]])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], VECTORS)
    assert hnsw.search(docs, F.lit(True)).collect() == []
    assert hard_negatives.mined(hard_negatives.quantised(docs), F.lit(True)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (100, [0.0, 1.0], 2)], VECTORS)
    assert [(r["query_id"], r["vec_id"]) for r in hnsw.search(few, F.expr("vec_id = 0")).collect()] == [(0, 100)]
    assert hard_negatives.mined(hard_negatives.quantised(few), F.lit(True)).collect() == []
    texts = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.audited(texts).collect() == []


def audited_plainly(rows, min_df, top):
    rows = [(t or "", lang or "", source or "") for t, lang, source in rows]
    words = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(words(t), s) for t, x, s in rows if x == lang]
        df = Counter(w for ws, _ in own for w in set(ws))
        kept = sorted((w for w in df if df[w] >= min_df), key=lambda w: w.encode())
        p = {}
        for s in {s for _, s in own} | {None}:
            n = Counter(w for ws, x in own if s is None or x == s for w in ws)
            total = sum(n[w] for w in kept)
            p[s] = {w: 1 + 10**9 * (n[w] + 1) // (total + len(kept)) for w in kept}, n
        for s in p:
            if s is None:
                continue
            values = [(-sum((p[s][0][w] - p[o][0][w]) ** 2 // p[o][0][w] for w in kept), o) for o in p if o is not None and o != s]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, o) in enumerate(sorted(values, key=lambda x: (x[0], x[1].encode())))]
            q = p[None][0]
            terms = sorted(((-((p[s][0][w] - q[w]) ** 2 // q[w]), w) for w in kept if p[s][1][w] and p[s][0][w] > q[w]), key=lambda x: (x[0], x[1].encode()))
            out += [(lang, s, "term", w, -v, k + 1) for k, (v, w) in enumerate(terms[:top])]
    return sorted(out)


@pytest.mark.parametrize("bucket_rows", [7, 200_000])
def test_divergence_is_that_of_brute_force(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(divergence, "PIECE", 16)
    rng = random.Random(9)
    vocabulary = ["the", "The", "été", "ÉTÉ", "straße", "x", "naïve", "日本", "don"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(rng.choices(vocabulary, weights=[k % 5 + 1 for k in range(len(vocabulary))], k=rng.randrange(40))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "d"])) for _ in range(150)]
    rows += rows[:9] + [(None, "en", "only null"), ("", "xx", "empty"), ("1 2 3", "xx", "digits"), ("rare words", "yy", "alone"), ("don't re-do\tA1B\n\x00x", "en", "a")]
    rows += [("the " * 50_000, "en", "long")] + [("hot " * 3, "en", "a")] * 200
    docs = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string").withColumns({c: F.lit("x") for c in ("n", "df", "p", "item", "bucket")})
    out = divergence.audited(docs, min_df=3, top=5, bucket_rows=bucket_rows)
    assert sorted(tuple(r) for r in out.select("lang", "source", "part", "item", "value", "rank").collect()) == audited_plainly(rows, 3, 5)


def test_sums_are_written_out_in_pieces(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{'bc'[i % 2]} z z", "en", "s") for i in range(40)], "doc_id long, text string, lang string, source string").coalesce(1)
    rows = [r.asDict() for r in divergence.group_sums(docs).groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).collect()]
    assert sorted((str(r["term"]), r["n"], r["df"]) for r in rows) == [("None", 0, 0), ("ab", 20, 20), ("ac", 20, 20), ("z", 80, 40)]
    vectors = {tuple(r) for r in divergence.document_vectors(docs).select("doc_id", F.array_join("terms", " "), F.array_join("counts", " ")).collect()}
    assert (0, "ab z", "1 2") in vectors and len(vectors) == 40


def test_very_long_texts_are_read_to_their_ends(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    half, other, third = ([word() for _ in range(40_000)] for _ in range(3))
    texts = [" ".join(half + other), " ".join(half + other[:-1] + ["changed"]), " ".join(half + third)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = sorted(tuple(r) for r in minhash.near_duplicates(docs, size=4).select("doc_id", "n_shingles", "component_id").collect())
    sets = [len({tuple(w[k : k + 4]) for k in range(len(w) - 3)}) for w in (t.split() for t in texts)]
    # the third shares its first half with the others
    assert out == [(0, sets[0], 0), (1, sets[1], 0), (2, sets[2], 2)]
    loud = texts[0] + " !" * 80_000
    plain, marked = (dict(zip(quality_gam.FEATURES, quality_gam.features(t), strict=True)) for t in (texts[0], loud))
    assert plain["marks"] == 0 and marked["marks"] > 0.1 and marked["log_words"] > plain["log_words"]


def test_a_labelled_doc_id_on_many_rows_is_taught_once(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    one = [(k, ("good words here. " if k % 2 else "BAD ### ") * (k + 1)) for k in range(40)]
    many = one + [one[1]] * 500
    models = [quality_gam.train(spark.createDataFrame(rows, "doc_id long, text string"), labels) for rows in (one, many)]
    x = np.array([quality_gam.features(t) for _, t in one])
    assert np.array_equal(models[0].score(x), models[1].score(x))
