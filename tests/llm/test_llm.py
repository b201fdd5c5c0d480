import collections
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm import (
    chat_format, decontamination, html_extraction, license_scan, line_dedup, minhash, packing, quality_gam, quality_rules, queries, token_counts,
)

from ..conftest import SF

WORD = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f g h i j k l m n. " * 400), (6, "same text here"), (6, "same text here"), (6, "other text"), (None, "x y z")]


@pytest.fixture(scope="module")
def odd(spark):
    # an extra column with a name that an operator might use
    return spark.createDataFrame([(*r, "h", 1) for r in ODD], DOCS + ", source string, n_words int").drop("n_words").withColumn("score", F.lit("x"))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    base = duckdb.connect()
    for t in "documents benchmark conversations pages labels embeddings".split():
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.queries()[name](spark, SF), base.execute(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda v: None if v is None or v != v else v
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(map(plain, r)) for r in want[columns].astype(object).values.tolist()), key=repr)


def operators(spark, docs):
    bench = spark.createDataFrame([(1, "one"), (2, None), (3, "")], "item_id long, text string")
    yield decontamination.decontaminate(docs, bench)
    yield packing.pack(docs, WORD)
    yield license_scan.scan(docs)
    yield line_dedup.without_boilerplate(docs)
    yield token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    yield quality_gam.scored(docs, quality_gam.train(docs, spark.createDataFrame([(4, 1), (5, 0), (4, 1)], "doc_id long, quality int")))
    yield quality_rules.with_rules(docs)
    yield minhash.near_duplicates(docs)


def test_odd_rows_keep_their_number(spark, odd):
    for out in operators(spark, odd):
        ids = collections.Counter(r["doc_id"] for r in out.collect())
        assert set(ids) == {1, 2, 3, 4, 5, 6, None} and ids[6] == 3


def test_empty_tables(spark, odd):
    for out in operators(spark, odd.limit(0)):
        assert out.count() == 0
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extraction.extracted(none, html_extraction.train(none)).count() == 0
    talk = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.linked(*chat_format.calls_of(talk)).count() == 0


def test_decontamination_without_broadcast(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda **how: sorted(map(str, decontamination.decontaminate(docs, bench, **how).collect()))
    assert rows() == rows(broadcast_bytes=-1)


def test_packing_is_whole_and_tight(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [(-1, "it's <|endoftext|> a\x1fb  ΑΣ İx é   GROSS ßen, ###!! 12"), (-2, None)]
    docs = docs.union(spark.createDataFrame(more, DOCS))
    full, texts = Tokenizer.from_file(WORD), {r["doc_id"]: r["text"] for r in docs.collect()}
    out = packing.pack(docs, WORD, shard_pieces=100).toPandas()
    for doc_id, parts in out.sort_values("start").groupby("doc_id"):
        ids = [*full.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in parts.itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s["length"].sum() <= 4096 and (s["offset"].to_numpy() == np.concatenate(([0], np.cumsum(s["length"])[:-1]))).all()


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(1)
    lengths = np.array(sorted((rng.randint(1, 64) for _ in range(400)), reverse=True))
    sequence, _ = packing.best_fit(lengths, 64)
    room: list[int] = []
    for n, got in zip(lengths.tolist(), sequence.tolist(), strict=True):
        fits = [r for r in room if r >= n]
        if fits:
            assert room[got] == min(fits)
            room[got] -= n
        else:
            assert got == len(room)
            room.append(64 - n)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    texts, base = [], [word() for _ in range(60)]
    for _ in range(60):  # a large group around the threshold
        texts.append([w if rng.random() > 0.03 else word() for w in base])
    texts += [[word() for _ in range(rng.randint(1, 40))] for _ in range(60)]
    texts += texts[:5] + [[], ["x"], ["x"]]
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = {k: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set() for k, t in enumerate(texts)}
    comp = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = comp[a], comp[b]
                comp = {k: min(x, y) if c in (x, y) else c for k, c in comp.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {k: (len(sets[k]), comp[k]) for k in sets}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["comp"] for r in minhash.components(links).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, 100: 100, 101: 100}


def test_token_counts_match_the_tokenizer(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(150)
    encode = token_counts.encoder(path).encode_ordinary
    want = {r["doc_id"]: len(encode(r["text"])) for r in docs.collect()}
    got = token_counts.count_tokens(docs, path, shard_chars=50_000).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and len({r["shard"] for r in got}) > 1


def test_blocks_are_stitched(spark, tmp_path):
    end = token_counts.END_ID
    (tmp_path / "shard=0").mkdir()
    ids = [5] * 7 + [end, end] + [6] * 9 + [end] + [7] * 3
    (tmp_path / "shard=0/a.txt").write_bytes(np.array(ids, ">u2").tobytes())
    rows = token_counts.scan(spark, str(tmp_path), block=4).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["start"], r["n_tokens"]) for r in rows] == [(0, 0, 7), (1, 8, 0), (2, 9, 9)]


def test_gam_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op8_quality_gam(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum((r["score"] >= 0.5) == r["quality"] for r in rows) / len(rows) > 0.93


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality_gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_html_extraction_on_other_layouts():
    texts = ["Some words of a plain text, which go on a little and then end here."] * 5 + ["Short one, too. And another sentence of it."]
    model = html_extraction.fit(html_extraction.labelled_pages(texts, 300))
    page = "<body><header><a href=/>Home</a></header><div class='sidebar'><p>Buy this now</p></div><main><h1>A &amp; B</h1><p>First  part\nof it.<p>Second part, longer than it was.</main><script>x<1</script><div class='comments'><p>I liked it.</p></div><footer>&copy; me</footer>"
    assert model.text(page) == "A & B\nFirst part of it.\nSecond part, longer than it was."
    assert model.text(None) == model.text("") == model.text("<nav>a</nav") == ""


def test_viterbi_is_the_best_labelling():
    import itertools

    items = [html_extraction.Block(t, ("p",), (), 0) for t in ("a b", "c, d", "e.", "f g h i")]
    model = html_extraction.Crf({"one": 0.3, "words:2": -1.0, "end:True": 2.0, "commas:1": -0.5}, np.array([[0.5, -0.7], [-0.9, 0.6]]))
    unary = [sum(model.weights.get(f, 0) for f in fs) for fs in html_extraction.block_features(items)]
    value = lambda y: sum(u for u, k in zip(unary, y, strict=True) if k) + sum(model.steps[a, b] for a, b in itertools.pairwise(y))
    assert tuple(model.decode(items)) == max(itertools.product((0, 1), repeat=4), key=value)


def test_licenses_need_their_sentences_in_order(spark):
    s = license_scan.SENTENCES
    rows = [(1, s["mit-permission"] + " Other words here. " + s["mit-as-is"]), (2, s["mit-as-is"] + "\n" + s["mit-permission"]), (3, "x\n" + s["cc-by-nc"].upper())]
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: "MIT", 2: "", 3: "CC-BY-NC-4.0"}


def test_calls_follow_chains_and_cycles_have_no_level(spark):
    calls = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "gone")]
    got = chat_format.levels(spark.createDataFrame(calls, "call_id string, after string")).collect()
    assert {r["call_id"]: r["level"] for r in got} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "z": 0}


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = before = P.table(spark, SF, "documents")
    for name, stage in P.STAGES[:-1]:
        docs = P.stored(stage(spark, docs, SF), name)
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
        before = docs
    pieces = P.pack(spark, docs, SF)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
