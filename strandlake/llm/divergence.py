"""How the sources of a language differ in their words: exact counts, smoothed shares, divergences.

1. Each text becomes a sparse vector, its terms and their counts (:func:`vector`), and tasks sum the
   vectors of each (lang, source) and the documents of each term before anything is shuffled.
   What a task holds is written out whenever it reaches ``HELD`` terms.
2. The vocabulary of a language is the terms in ``min_df`` of its documents or more, without a
   limit on their number.  It stays a table: each sum is filtered by it where the counts of its
   term meet, in the same shuffle.  (Spark ML's CountVectorizer has the same vocabulary, but holds
   it on the driver and sends it to every task, and it grows with the corpus.)
3. Shares p are whole numbers, and so are all sums.
4. The divergence of two sources is a sum over all terms.  A source has one share for all the
   terms it lacks, so only three sparse parts are computed (:func:`pairs`): terms of one source
   against the other's share of a lacking term, by how often each share occurs; the same the
   other way; and a correction for each term that both have, in buckets of terms.

Memory: a task holds HELD terms, then a bucket of about ``bucket_rows`` sums; a term's sums are as many as
its sources.  Rows grow with the sums of sources, and with the pairs of sources, which are the result.

Defined results: null text, lang and source are empty strings; texts without terms count as
documents of their group; a language without kept terms has pairs of value 0 and no terms;
repeated rows are documents of their own; a text of any length is cut whole, in one task; ties go
by the item's bytes; a source alone in its language has no pairs; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: A-Z in lower case, other letters and all further bytes as they are, and blanks for the rest.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Terms of all groups that a task sums up before it writes them out, and the whole of all shares.
HELD, WHOLE = 400_000, 1_000_000_000
#: Parts into which the shares of a language are dealt.
SALTS = 64
#: Pairs of sums compared at once.
PIECE = 1 << 20


def vector(text: str | None) -> Counter:
    """The terms of a text (as UTF-8) and their counts."""
    return Counter((text or "").encode("utf-8", "replace").translate(LETTERS).split())


def document_vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, terms, counts): each document's sparse vector, its terms in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            found = [sorted(vector(t).items()) for t in batch.column(3).to_pylist()]
            lists = [pa.array([[x[k] for x in f] for f in found], pa.list_(t)) for k, t in ((0, pa.binary()), (1, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists[0].cast(pa.list_(pa.string())), lists[1]], names=["doc_id", "lang", "source", "terms", "counts"])

    return grouped_rows(docs, "doc_id").mapInArrow(run, "doc_id long, lang string, source string, terms array<string>, counts array<long>")


def grouped_rows(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), "text")


def group_sums(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences of each term and documents with it, as summed by each
    task; a null term stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = {}
        dfs: dict[tuple[str, str], Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), c in counts.items():
                terms = list(c)
                df = dfs[lang, source]
                columns = [pa.array([*terms, None], pa.binary()).cast(pa.string()), pa.array([*c.values(), 0], pa.int64()), pa.array([*map(df.__getitem__, terms), 0], pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([x] * (len(c) + 1), pa.string()) for x in (lang, source)] + columns, names=["lang", "source", "term", "n", "df"])
            counts.clear(), dfs.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                key = lang.as_py(), source.as_py()
                mine, df = counts.setdefault(key, Counter()), dfs.setdefault(key, Counter())
                before, found = len(mine), vector(text.as_py())
                for term, n in found.items():
                    mine[term] += n
                df.update(found.keys())
                held += len(mine) - before
                if held >= HELD:
                    yield from out()
                    held = 0
        yield from out()

    return grouped_rows(docs).mapInArrow(run, "lang string, source string, term string, n long, df long")


def share(count: str, total: str, terms: str) -> str:
    """A smoothed share, 1 + floor(WHOLE * (count + 1) / (total + terms)), in exact arithmetic."""
    return f"1 + cast((cast({WHOLE} AS decimal(12,0)) * cast({count} + 1 AS decimal(20,0))) div cast({total} + {terms} AS decimal(20,0)) AS long)"


def apart(p: str, q: str) -> str:
    """floor((p - q)^2 / q); shares lie within some 1e9, so this fits a long."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def corrections(bucket: pa.Table) -> pa.Table:
    """(lang, source, item, v): for each two sources with a common term, the sum over these terms of what
    their divergence differs by from that of terms of only one of them.

    ``bucket``: (lang, source, term, p, z): share of the term, and of a term that the source lacks.
    """
    codes, names = [], []
    for c in ("lang", "source", "term"):
        coded = bucket.column(c).combine_chunks().dictionary_encode()
        codes.append(coded.indices.to_numpy().astype(np.int64)), names.append(coded.dictionary)
    lang, source, term = codes
    order = np.lexsort((source, term, lang))
    lang, source, term, p, z = (x[order] for x in (lang, source, term, bucket.column("p").to_numpy(), bucket.column("z").to_numpy()))
    begins = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (lang[1:] != lang[:-1]))))
    size = np.diff(np.append(begins, len(term)))
    begin, size = np.repeat(begins, size), np.repeat(size, size)
    place = np.arange(len(term)) - begin
    f = lambda a, b: (a - b) ** 2 // b
    n = len(names[1])
    total = pd.Series([], dtype=np.int64, index=np.empty(0, np.int64))
    # each sum meets the others of its term, the next ones first
    for step in range(1, int(size.max(initial=1))):
        some = np.flatnonzero(size > step)
        for part in range(0, len(some), PIECE):
            i = some[part : part + PIECE]
            j = begin[i] + (place[i] + step) % size[i]
            v = f(p[i], p[j]) - f(p[i], z[j]) - f(z[i], p[j]) + f(z[i], z[j])
            new = pd.Series(v).groupby((lang[i] * n + source[i]) * n + source[j]).sum()
            total = pd.concat([total, new]).groupby(level=0).sum()
    code = total.index.to_numpy(np.int64)
    held = [names[0].take(pa.array(code // (n * n))), names[1].take(pa.array(code // n % n)), names[1].take(pa.array(code % n))] if n else [pa.array([], pa.string())] * 3
    return pa.table(dict(zip(("lang", "source", "item", "v"), [*held, pa.array(total.to_numpy(np.int64))], strict=True)))


def pairs(sums: DataFrame, groups: DataFrame, bucket_rows: int) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language."""
    buckets = max(1, math.ceil(sums.count() / bucket_rows))
    dealt = sums.select("lang", "source", "term", "p", "z", F.pmod(F.xxhash64("lang", "term"), F.lit(buckets)).cast("int").alias("bucket"))
    both = dealt.groupBy("bucket").applyInArrow(corrections, "lang string, source string, item string, v long")
    # how many terms of a source have each share, against the others' share of a lacking term
    often = sums.groupBy("lang", "source", "p", "z").agg(F.count("*").alias("n"))
    often = often.withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALTS)).cast("int"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = often.join(others, ["lang", "salt"]).filter("source <> item")
    out, back = (F.sum(F.expr(f"n * ({apart(*x)} - ({apart(*y)}))")) for x, y in ((("p", "y"), ("z", "y")), (("y", "p"), ("y", "z"))))
    one = met.groupBy("lang", "source", "item").agg(out.alias("out"), back.alias("back"))
    whole = groups.join(groups.select("lang", F.col("source").alias("item"), F.col("z").alias("y")), "lang").filter("source <> item")
    parts = [
        whole.select("lang", "source", "item", F.expr(f"terms * ({apart('z', 'y')})").alias("v")),
        one.select("lang", "source", "item", F.col("out").alias("v")),
        one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("v")),
        both.select("lang", "source", "item", "v"),
    ]
    added = parts[0]
    for part in parts[1:]:
        added = added.unionByName(part)
    return added.groupBy("lang", "source", "item").agg(F.sum("v").alias("value"))


def audited(docs: DataFrame, min_df: int = 3, top: int = 200, bucket_rows: int = 200_000) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources of each source's language by their divergence
    (part ``pair``), and the ``top`` terms in which a source exceeds its language (part ``term``)."""
    shared_dir(docs.sparkSession)
    # one shuffle by term: the sums of a source, and over them the documents of the whole language
    met = group_sums(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    of_lang = Window.partitionBy("lang", "term")
    kept = met.withColumns({"whole": F.sum("n").over(of_lang), "df": F.sum("df").over(of_lang)}).filter(f"term IS NULL OR df >= {int(min_df)}")
    sums = stored(kept.select("lang", "source", "term", "n", "whole"), "sums")
    terms = sums.filter("term IS NOT NULL")
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_terms = terms.groupBy("lang", "term").agg(F.first("whole").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("whole_total"))
    # a row for each source of each language
    groups = sums.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(of_terms, "lang", "left").na.fill(0)
    groups = stored(groups.withColumn("z", F.expr(f"CASE WHEN terms = 0 THEN 1 ELSE {share('0', 'total', 'greatest(terms, 1)')} END")), "groups")
    shares = terms.join(groups, ["lang", "source"]).withColumns({"p": F.expr(share("n", "total", "terms")), "q": F.expr(share("whole", "whole_total", "terms"))})
    shares = stored(shares.select("lang", "source", "term", "p", "q", "z"), "shares")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(apart("p", "q")).alias("value"))
    best = best.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    others = pairs(shares, groups, bucket_rows).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return others.union(best).withColumn("rank", F.col("rank").cast("int"))
