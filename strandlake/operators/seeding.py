"""Seed joins between read peptides and proteins, and the filters on seeds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.sequences import kmers
from strandlake.operators import neighbours
from strandlake.operators.index import LONGEST
from strandlake.tables import stored

#: Bytes of the smaller side up to which a join may broadcast it.
BROADCAST_BYTES = 64 << 20
#: Different k-mers of the proteins up to which every task knows them (8 bytes each, and their rows).
KNOWN_KMERS = 200_000
#: Letters of suffixes that are compared first; most matches are shorter.
SHORT = 24
#: Parts in which the reads of a k-mer are joined beyond that.
SALTS = 8


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast if its rows, as JSON, have no more than ``most`` bytes."""
    size = df.select(F.length(F.to_json(F.struct("*"))).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most else df


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of a scan, dealt to as many tasks as there are cores if it has fewer, as with one file of
    one row group: the work on a read is far more than its bytes.  Larger scans stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def seed_join(peptides: DataFrame, proteins: DataFrame, k: int, multiplicity: int) -> DataFrame:
    """(doc_id, frame, prot_id, q_pos, r_pos): equal ``k``-mers; a k-mer on more than ``multiplicity``
    protein positions counts at its first one only, which also bounds what a common k-mer yields.

    Up to KNOWN_KMERS different k-mers of the proteins go to the tasks, which leave out all others;
    beyond that, all k-mers of the peptides are joined, in SALTS parts of each k-mer.
    """
    ref = kmers(proteins, "aa", k, ["prot_id"])
    count = ref.groupBy("kmer").agg(F.count("*").alias("n"), F.min(F.struct("prot_id", "pos")).alias("first"))
    rare = ref.join(count.filter(F.col("n") <= multiplicity).select("kmer"), "kmer").select("kmer", "prot_id", F.col("pos").alias("r_pos"))
    rows = rare.union(count.filter(F.col("n") > multiplicity).select("kmer", "first.prot_id", "first.pos"))
    known = rows.select("kmer").distinct().limit(KNOWN_KMERS + 1).toPandas()["kmer"].to_numpy(np.int64)
    if len(known) <= KNOWN_KMERS:
        sent = peptides.sparkSession.sparkContext.broadcast(np.sort(known))
        query = kmers(peptides, "aa", k, ["doc_id", "frame"], sent).withColumnRenamed("pos", "q_pos")
        return query.join(F.broadcast(rows), "kmer").select("doc_id", "frame", "prot_id", "q_pos", "r_pos")
    query = kmers(peptides, "aa", k, ["doc_id", "frame"]).withColumnRenamed("pos", "q_pos")
    query = query.withColumn("salt", F.pmod(F.xxhash64("doc_id", "q_pos"), F.lit(SALTS)).cast("int"))
    rows = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return query.join(rows, ["kmer", "salt"]).select("doc_id", "frame", "prot_id", "q_pos", "r_pos")


def adaptive_seed_join(queries: DataFrame, found: DataFrame, multiplicity: int, longest: int = LONGEST, small_partitions: bool = False) -> DataFrame:
    """(q_id, q_pos, prot_id, pos, len): the longest prefix that a query suffix shares with any
    protein suffix (four letters at least), and the protein suffixes that share it: all if they
    are no more than ``multiplicity``, else the first.  Both sides should hold ``longest`` letters.

    ``small_partitions``: a query suffix whose three-letter prefix starts no more than
    ``multiplicity`` protein suffixes gets all of those instead, with length 3.

    Suffixes go to ranges of the sorted order (:mod:`neighbours`) with their first SHORT letters; only
    those that match on all of these go once more, with ``longest``.
    """
    if small_partitions:
        rare = small(found.groupBy(F.substring("suffix", 1, 3).alias("_p3")).agg(F.count("*").alias("_n")).filter(F.col("_n") <= multiplicity).select("_p3"))
        mine = queries.withColumn("_p3", F.substring("suffix", 1, 3)).join(rare, "_p3").select("_p3", "q_id", "q_pos")
        theirs = small(found.withColumn("_p3", F.substring("suffix", 1, 3)).join(rare, "_p3", "left_semi").select("_p3", "prot_id", "pos"))
        short = mine.join(theirs, "_p3").select("q_id", "q_pos", "prot_id", "pos", F.lit(3).cast("long").alias("len"))
        rest = queries.join(rare, F.substring("suffix", 1, 3) == F.col("_p3"), "left_anti")
        return adaptive_seed_join(rest, found, multiplicity, longest).union(short)
    columns = ["q_id", "q_pos", "prot_id", "pos", "len"]
    if longest <= SHORT:
        return neighbours.matches(queries, found, multiplicity, longest).select(columns)
    first = stored(neighbours.matches(queries, found, multiplicity, SHORT).select(columns), "seeds")
    deep = first.filter(F.col("len") == SHORT).select("q_id", "q_pos").distinct()
    again = neighbours.matches(queries.join(deep, ["q_id", "q_pos"], "left_semi"), found, multiplicity, longest).select(columns)
    # of two suffixes alike in (q_id, q_pos) only one may be deep; the other is in ``first``
    return first.filter(F.col("len") < SHORT).union(again.filter(F.col("len") >= SHORT))


def suppress_covered(seeds: DataFrame, k: int) -> DataFrame:
    """Seeds that no earlier seed of their diagonal covers (islands of overlapping seeds keep their first)."""
    diagonal = Window.partitionBy("doc_id", "frame", "prot_id", "diag").orderBy("q_pos")
    step = seeds.withColumn("diag", F.col("q_pos") - F.col("r_pos"))
    return step.withColumn("_e", F.lag("q_pos").over(diagonal) + k).filter("_e IS NULL OR q_pos > _e").drop("_e")
