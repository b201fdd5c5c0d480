"""Line dedup by site-relative frequency.

Per host, the pages that contain a line are counted (each page once) and divided by the
host's pages; lines over ``ratio`` are boilerplate and are dropped from the host's pages.
Lines are compared without outer blanks, by two independent hashes (96 bits).  Counts are
summed before each shuffle, so a host with a third of all rows or a line on each of its
pages is no hot group; the drop list of a page holds no more than the page's lines.

Defined results: a null host is a host of its own; null texts stay null and count as pages
without lines; blank lines are never dropped; hosts on which a line stands on fewer than
``min_pages`` pages do not lose it, nor those that have it on just ``ratio`` of their pages;
a text of any length is read whole, row by row; rows alike in doc_id and text are pages of their own
and end alike; an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, stored

BLANKS = r"' \t\r\u000b\u000c'"
LINES = rf"transform(split(text, '\n', -1), l -> trim(BOTH {BLANKS} FROM l))"
PRINT = "struct(xxhash64({0}) AS x, hash({0}) AS y)"


def boilerplate(docs: DataFrame, host: str, ratio: float, min_pages: int) -> DataFrame:
    """(_host, _line): the lines over ``ratio`` of each host's pages."""
    pages = docs.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("pages"))
    prints = F.expr(f"explode(transform(array_distinct(filter({LINES}, l -> l <> '')), l -> {PRINT.format('l')}))")
    lines = docs.select(F.col(host).alias("_host"), prints.alias("_line")).groupBy("_host", "_line").agg(F.count("*").alias("n"))
    common = lines.filter(F.col("n") >= min_pages)
    on = common["_host"].eqNullSafe(pages["_host"])
    return common.join(pages, on).filter(F.col("n") > ratio * F.col("pages")).select(common["_host"], "_line")


def without_boilerplate(docs: DataFrame, host: str = "source", ratio: float = 0.05, min_pages: int = 5) -> DataFrame:
    """``docs`` with texts free of boilerplate, ``n_lines`` and ``n_dropped`` (which replace columns of these names)."""
    step, names = aside(docs, TAKEN)
    out = trimmed(step, names[host], ratio, min_pages)
    return out.select(*(F.col(there).alias(c) for c, there in names.items() if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped")


TAKEN = ["_host", "_line", "_h", "_i", "_drop", "_kept", "_salt", "n_lines", "n_dropped"]
#: Boilerplate lines of all hosts up to which they are broadcast (some 60 bytes each, and a host's name).
BROADCAST_LINES = 200_000
SALTS = 16


def trimmed(docs: DataFrame, host: str, ratio: float = 0.05, min_pages: int = 5) -> DataFrame:
    """As :func:`without_boilerplate`, for tables without columns named as in ``TAKEN``."""
    bad = stored(boilerplate(docs, host, ratio, min_pages), "boilerplate")
    prints = F.expr(f"explode(transform(array_distinct(filter({LINES}, l -> l <> '')), l -> {PRINT.format('l')}))")
    key = [F.col("doc_id").alias("_i"), F.xxhash64("text").alias("_h"), F.col(host).alias("_host")]
    lines = docs.select(*key, prints.alias("_line"))
    on = lines["_host"].eqNullSafe(bad["_host"]) & (lines["_line"] == bad["_line"])
    if bad.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        found = lines.join(F.broadcast(bad), on)
    else:
        # a line may stand on each page of a host: its pages are dealt to several tasks
        lines = lines.withColumn("_salt", F.pmod(F.xxhash64("_i", "_h"), F.lit(SALTS)))
        bad = bad.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        found = lines.join(bad, lines["_host"].eqNullSafe(bad["_host"]) & (lines["_line"] == bad["_line"]) & (lines["_salt"] == bad["_salt"]))
    drop = found.select("_i", "_h", lines["_host"], lines["_line"]).groupBy("_i", "_h", "_host").agg(F.collect_set("_line").alias("_drop"))
    same = docs["doc_id"].eqNullSafe(drop["_i"]) & (F.xxhash64(docs["text"]) == drop["_h"]) & docs[host].eqNullSafe(drop["_host"])
    out = docs.join(drop, same, "left")
    bare = f"trim(BOTH {BLANKS} FROM l)"
    goes = f"array_contains(_drop, {PRINT.format(bare)}) AND {bare} <> ''"
    kept = rf"CASE WHEN _drop IS NULL THEN text ELSE array_join(filter(split(text, '\n', -1), l -> NOT ({goes})), '\n') END"
    n = r"CASE WHEN text IS NULL THEN 0L ELSE CAST(size(split(text, '\n', -1)) AS BIGINT) END"
    dropped = rf"CASE WHEN _drop IS NULL THEN 0L ELSE CAST(size(filter(split(text, '\n', -1), l -> {goes})) AS BIGINT) END"
    out = out.withColumns({"_kept": F.expr(kept), "n_lines": F.expr(n), "n_dropped": F.expr(dropped)})
    columns = [F.col("_kept").alias("text") if c == "text" else docs[c] for c in docs.columns]
    return out.select(*columns, "n_lines", "n_dropped")


def clean_documents(docs: DataFrame, host: str = "source", **how: float) -> DataFrame:
    """``docs`` with boilerplate lines cut out of their texts; every document stays."""
    step, names = aside(docs, TAKEN)
    out = trimmed(step, names[host], **how)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(there).alias(c) for c, there in names.items()))
