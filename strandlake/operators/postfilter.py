"""Filters, unions and orders of finished alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.statistics import bit_score, coverage, evalue
from strandlake.tables import stored


def scored(found: DataFrame, letters: int, lam: float, k: float) -> DataFrame:
    """Adds bitscore, evalue and coverage; ``letters`` are those of the whole base."""
    return found.withColumns(
        {
            "bitscore": bit_score(F.col("score"), lam, k),
            "evalue": evalue(F.col("score"), F.col("read_len"), F.lit(letters), lam, k),
            "coverage": coverage(F.col("r_stop") - F.col("r_start"), F.col("ref_len")),
        }
    )


def significant(found: DataFrame, max_evalue: float, min_coverage: int) -> DataFrame:
    return found.filter((F.col("score") > 0) & (F.col("evalue") <= max_evalue) & (F.col("coverage") >= min_coverage))


def not_dominated(found: DataFrame, overlap: float = 0.9, share: float = 0.9) -> DataFrame:
    """Alignments over which no other of the same read lies with a clearly higher score, whatever its
    protein and strand.

    From an ``overlap`` of a half on, an alignment is only dominated by one that covers its middle, so
    each is sent to the cells of a grid that it covers, and is held against those of its middle's cell
    only.  Cells are as wide as the read's median alignment; below a half, a read is one cell.
    """
    # ``share`` times the other's bits exceeds its own only if the other's are more: no row meets itself
    size = found.groupBy("doc_id").agg((F.greatest(F.percentile_approx(F.col("q_stop") - F.col("q_start"), 0.5), F.lit(1)) if overlap >= 0.5 else F.lit(1 << 40)).alias("_w"))
    mine = found.join(size, "doc_id").withColumn("_cell", F.expr("(q_start + q_stop) div 2 div _w")).alias("h1")
    other = found.select("doc_id", "q_start", "q_stop", "bitscore").distinct().join(size, "doc_id")
    other = other.select(F.col("doc_id").alias("_d"), F.col("q_start").alias("_a"), F.col("q_stop").alias("_b"), F.col("bitscore").alias("_bits"), F.explode(F.expr("sequence(q_start div _w, q_stop div _w)")).alias("_c"))
    shared = F.least("q_stop", "_b") - F.greatest("q_start", "_a")
    more = (F.lit(share) * F.col("_bits") > F.col("bitscore")) & (F.col("_bits") > F.col("bitscore"))
    on = (F.col("doc_id") == F.col("_d")) & (F.col("_cell") == F.col("_c")) & (shared > F.lit(overlap) * (F.col("q_stop") - F.col("q_start"))) & more
    return mine.join(other, on, "left_anti").select(found.columns)


def merged(volumes: list[DataFrame]) -> DataFrame:
    """The alignments of several volumes without exact repeats."""
    out = volumes[0]
    for v in volumes[1:]:
        out = out.unionByName(v)
    return out.dropDuplicates()


def subject_ids(found: DataFrame, parts: int = 200) -> DataFrame:
    """(prot_id, name, subject): dense numbers of the subjects that were hit, by name.

    About ``parts`` names, chosen by their hashes, bound ranges of names: a number is the names of
    earlier ranges plus the place in the own one, so no task sees all names, and a range holds the
    same names however often it is computed.
    """
    # used four times below, while ``found`` may be a whole search
    names = stored(found.select("prot_id").distinct().withColumn("name", F.concat(F.lit("prot"), F.lpad(F.col("prot_id").cast("string"), 9, "0"))), "names")
    every = max(1, names.count() // parts)
    bounds = sorted(r["name"] for r in names.filter(F.pmod(F.xxhash64("name"), F.lit(every)) == 0).select("name").collect())
    held = F.array(*map(F.lit, bounds)).cast("array<string>")
    dealt = names.withColumn("part", F.size(F.filter(held, lambda b: b <= F.col("name"))))
    sizes = dealt.groupBy("part").count()
    before = sizes.withColumn("skip", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("name"))
    return dealt.withColumn("place", place).join(F.broadcast(before), "part").select("prot_id", "name", (F.col("skip") + F.col("place") - 1).alias("subject"))
