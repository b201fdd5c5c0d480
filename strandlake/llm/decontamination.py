"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is a run of ``width`` item words (a shorter item is one window).  All tokens of
a window must occur, so its necessary prefix is one token: the rarest of its words by counts
over all windows, of equally rare ones the longest.  Document words join these tokens; the
token's place in the window and the document's length bound where the window can lie; there
the words are compared one by one.  Occurrences are merged to intervals, whose words are the
hit words.

Each text is cut into words once: the empty word behind its last one joins a row that every
document meets, which brings the number of words.  The windows are broadcast only if the
benchmark's words keep them under ``broadcast_bytes``; otherwise places and windows are
joined by a shuffle (salted, as a token may be common), and the candidates are verified after
a second join with the documents.

Defined results: null texts have no words, hit nothing and are not contaminated; rows
that are alike in ``doc_id`` and ``text`` each get the same result; rows that share only
the ``doc_id`` are judged apart; items that share a window all count, and repeated items
once; null item texts have no windows; a text of any length is read whole, row by row;
further columns are ignored, and passed through by :func:`clean_documents` under any names;
empty tables give empty results, or no hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ALNUM, ascii_lower, cut, stored, words

WIDTH = 13
BROADCAST_BYTES = 64 << 20
#: Parts of each token's places where windows are not broadcast.
SALTS = 16


def windows_of(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(window words, item ids): each different window once."""
    item = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(ascii_lower(F.col("text")), NO_ALNUM).alias("w")).filter("size(w) > 0")
    starts = item.select("item_id", "w", F.explode(F.expr(f"sequence(0, greatest(size(w) - {width}, 0))")).alias("s"))
    return (
        starts.select("item_id", F.expr(f"slice(w, s + 1, {width})").alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item_id").alias("items"))
    )


def with_prefix(windows: DataFrame, small: bool) -> DataFrame:
    """Each window with ``token``, its rarest word, and ``at``, where it stands; ``small`` windows' words may be broadcast."""
    tokens = windows.select("window", F.posexplode("window").alias("at", "token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct("n", -F.length("token"), "token", "at"))
    return tokens.join(F.broadcast(counts) if small else counts, "token").groupBy("window").agg(rarest.alias("r")).select("window", "r.token", "r.at").join(windows, "window")


def occurrences(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, _h, n_words) of each document, and (doc_id, _h, start, stop, items) of each place
    where a window occurs; ``_h`` is the text's hash."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = docs.select("doc_id", F.xxhash64("text").alias("_h"), cut(ascii_lower(F.col("text")), NO_ALNUM).alias("w"))
    small = size * width <= broadcast_bytes
    windows = stored(with_prefix(stored(windows_of(benchmark, width), "windows"), small), "prefixes").select("token", "at", "window", "items")
    n_words = F.expr("CAST(size(w) - 1 - int(w[0] = '') AS BIGINT)").alias("n_words")
    same = "slice(w, p - at + 1, size(window)) = window"
    span = [F.expr("p - at").alias("start"), F.expr("p - at + size(window)").alias("stop"), F.col("items")]
    if small:
        end = docs.sparkSession.range(1).selectExpr("'' AS token", "0 AS at", "CAST(array() AS ARRAY<STRING>) AS window", "CAST(array() AS ARRAY<STRING>) AS items")
        ends = "word = '' AND p = size(w) - 1"
        inside = f"word <> '' AND p >= at AND p - at + size(window) < size(w) AND {same}"
        places = rows.select("doc_id", "_h", "w", F.posexplode("w").alias("p", "word"))
        met = places.join(F.broadcast(windows.union(end)), F.expr(f"word = token AND (({ends}) OR ({inside}))"))
        met = stored(met.select("doc_id", "_h", F.expr("word = ''").alias("over"), F.when(F.expr("word = ''"), n_words).alias("n_words"), *span), "occurrences")
        return met.filter("over").select("doc_id", "_h", "n_words"), met.filter("NOT over").drop("over", "n_words")
    salt = F.pmod(F.xxhash64("doc_id", "_h", "p"), F.lit(SALTS)).alias("salt")
    places = rows.select("doc_id", "_h", F.size("w").alias("n"), F.posexplode("w").alias("p", "token")).select("*", salt)
    dealt = windows.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    cand = places.join(dealt, ["token", "salt"]).filter("p >= at AND p - at + size(window) < n")
    cand = cand.select(F.col("doc_id").alias("i"), F.col("_h").alias("h"), "p", "at", "window", "items").distinct()
    hits = rows.dropDuplicates(["doc_id", "_h"]).join(cand, F.expr(f"doc_id <=> i AND _h = h AND {same}"))
    return rows.select("doc_id", "_h", n_words), hits.select("doc_id", "_h", *span)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, one_in: int = 20, **how: int) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids, contaminated.

    ``contaminated``: some word is hit, and at least one word of ``one_in`` is.
    """
    counts, found = occurrences(docs, benchmark, width, **how)
    before = Window.partitionBy("doc_id", "_h").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy("doc_id", "_h", "start", "stop").agg(F.first("items").alias("items"))
    fresh = F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0)))
    hit = (
        spans.withColumn("fresh", F.greatest(fresh, F.lit(0)))
        .groupBy(F.col("doc_id").alias("i"), F.col("_h").alias("h"))
        .agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    )
    out = counts.join(hit, F.expr("doc_id <=> i AND _h = h"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    items = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("item_ids"),
        ((n_hit > 0) & (one_in * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.col("_h"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **how: int) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = decontaminate(docs, benchmark, **how).filter("contaminated").select(F.col("doc_id").alias("_i"), "_h").distinct()
    same = docs["doc_id"].eqNullSafe(bad["_i"]) & (F.xxhash64(docs["text"]) == bad["_h"])
    return docs.join(bad, same, "left_anti")
