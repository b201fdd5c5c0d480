"""The whole search: an index of proteins, reads against it, and conversion of the result."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.config import SearchConfig
from strandlake.functions.sequences import normal_dna
from strandlake.functions.statistics import ka, known_rows, read_matrix, ungapped
from strandlake.operators.seeding import spread
from strandlake.operators import alignment, chaining, extension, index, postfilter, replay, seeding
from strandlake.sources import daa
from strandlake.sources.fasta import first_of_names, read_fasta
from strandlake.tables import stored


#: Chains that a task aligns, the most tasks that chains are dealt to at once, and about the chains that go with a read.
CHAINS_A_TASK, MOST_TASKS, CHAINS_A_ROW = 20_000, 50_000, 100


def make_db(spark, fasta: str, path: str, sampling: tuple[int, int] | None = None) -> None:
    """Proteins and their sorted suffixes as two tables under ``path``; the first protein of a name counts.
    ``sampling``: (p, q) of the minimizers that alone are indexed."""
    proteins = first_of_names(read_fasta(spark, fasta)).select(F.monotonically_increasing_id().alias("prot_id"), "id", F.col("seq").alias("aa"))
    proteins.write.parquet(f"{path}/proteins")
    index.write_index(spark.read.parquet(f"{path}/proteins"), f"{path}/suffixes", sampling)


def read_db(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Proteins (prot_id, id, aa) and suffixes of an index."""
    return spark.read.parquet(f"{path}/proteins"), spark.read.parquet(f"{path}/suffixes")


def scoring(spark, config: SearchConfig) -> tuple[np.ndarray, float, float]:
    """The scores by two letters' codes, lambda and K.  A matrix file goes with the statistics of its
    name and penalties; scores by match and mismatch with their own."""
    if config.matrix_path:
        # a matrix of some 27 letters
        rows = [tuple(r) for r in read_matrix(spark, config.matrix_path).collect()]
        return (alignment.score_table(rows, 0, 0), *ka(config.matrix, config.gap_open, config.gap_extend, known_rows(spark, config.statistics_path))[:2])
    table = alignment.score_table(None, config.match, config.mismatch)
    return (table, *ungapped(table)[:2])


def seeds(reads: DataFrame, proteins: DataFrame, config: SearchConfig, suffixes: DataFrame | None = None) -> DataFrame:
    """The adaptive seeds of all six frames, extended both ways, that reach the least seed score;
    ``suffixes`` of an index spare a large base their making."""
    table, lam, k = scoring(reads.sparkSession, config)
    found = extension.seeds(spread(reads.select("doc_id", "dna")), proteins, config.multiplicity, table, lam, k, suffixes=suffixes, origin=config.query_skip, sampling=config.sampling)
    return replay.query_skip(found).drop("at", "match").distinct() if config.query_skip else found


def chains(reads: DataFrame, proteins: DataFrame, config: SearchConfig, suffixes: DataFrame | None = None) -> DataFrame:
    """The linear seed chain of each read and protein on the better strand; without frame shifts, of the
    frame with the heaviest window."""
    return chaining.chains(seeds(reads, proteins, config, suffixes), proteins, by_frame=config.frameshift is None)


def blastx(reads: DataFrame, proteins: DataFrame, config: SearchConfig = SearchConfig(), suffixes: DataFrame | None = None) -> DataFrame:
    """Alignments of ``reads`` (doc_id, dna) with ``proteins`` (prot_id, aa) that pass the filters: from
    each chain's heaviest seed, and from its seeds that no alignment holds yet."""
    table, lam, k = scoring(reads.sparkSession, config)
    letters = int(proteins.agg(F.coalesce(F.sum(F.length("aa")), F.lit(0))).first()[0])
    x_drop = gapped_x_drop(letters, lam, k)
    band = config.band or 3 * max((x_drop - config.gap_open) // max(config.gap_extend, 1), 10)
    found = stored(chains(reads, proteins, config, suffixes).select("doc_id", "prot_id", "strand", "seeds"), "chains")
    # a read goes once with up to CHAINS_A_ROW of its chains, not once with each
    rows = found.groupBy("doc_id").agg(F.ceil(F.count("*") / CHAINS_A_ROW).alias("rows"))
    named = found.join(seeding.small(proteins.select("prot_id", F.col("aa").alias("protein"))), "prot_id").join(rows, "doc_id")
    row = F.pmod(F.xxhash64("prot_id", "strand"), F.col("rows")).alias("row")
    of_read = named.groupBy("doc_id", row).agg(F.collect_list(F.struct("prot_id", "strand", "protein", "seeds")).alias("chains"))
    both = of_read.join(reads.select("doc_id", "dna"), "doc_id")
    # the least raw score under which no alignment passes the filters
    least = F.greatest(F.ceil((F.log(F.lit(k) * letters * F.length("dna")) - math.log(config.max_evalue)) / lam - 1e-9), F.lit(x_drop), F.lit(1))
    # chains are short rows, but not their alignment: tasks by their number, which Spark does not make less
    tasks = min(max(reads.sparkSession.sparkContext.defaultParallelism, -(-found.count() // CHAINS_A_TASK)), MOST_TASKS)
    dealt = both.withColumn("least", least.cast("long")).repartition(tasks)
    rows = alignment.gapped_by_read(dealt, table, config.gap_open, config.gap_extend, config.frameshift, x_drop, band)
    out = postfilter.significant(postfilter.scored(rows, letters, lam, k), config.max_evalue, config.min_coverage)
    # read three times by the filter: aligned once
    return postfilter.not_dominated(stored(out, "alignments"), config.dominance_overlap, config.dominance_score) if config.dominance else out


def gapped_x_drop(letters: int, lam: float, k: float) -> int:
    """The drop that ends a gapped extension: an expectation of 1e18 letters squared against reads of a million bases."""
    most = 1e18 / (2.0 * max(letters, 1) * 1e6)
    return round((math.log(k * 1e18) - math.log(most)) / lam)


def reads_of(rows: DataFrame, seq: str = "seq", name: str = "id") -> DataFrame:
    """Reads (doc_id, id, dna) as the search takes them, from a FASTA or FASTQ table, numbered in the order of
    files and records, once, and stored."""
    place = [c for c in ("file", "rank") if c in rows.columns]
    once = first_of_names(rows, name).repartitionByRange(*place).sortWithinPartitions(*place)
    once = once.select(F.col(name).alias("id"), normal_dna(F.col(seq)).alias("dna"))
    return stored(once.select(F.monotonically_increasing_id().alias("doc_id"), "id", "dna"), "reads")


def named(found: DataFrame, reads: DataFrame, proteins: DataFrame) -> DataFrame:
    """Alignments with the names and bases of their reads (doc_id, id, dna) and the names of their proteins (prot_id, id)."""
    names = reads.select("doc_id", F.col("id").alias("read_name"), "dna")
    subjects = proteins.select("prot_id", F.col("id").alias("subject"))
    out = found.join(names, "doc_id").join(seeding.small(subjects), "prot_id")
    return out.withColumns({"qseqid": F.col("read_name"), "sseqid": F.col("subject")})


def merge_archives(spark, paths: list[str], path: str, config: SearchConfig) -> None:
    """One archive from several of the same reads: equal alignments once, dominated ones left out if the
    configuration says so, names and lengths of all subjects."""
    same = [c for c in daa.HEADER_FIELDS if c in ("gap_open", "gap_extend", "shift", "k", "lambda", "matrix")]
    # an archive without volumes holds nothing to merge
    heads = [h for p in paths for h in daa.read_headers(spark, p).groupBy(*same).agg(F.max("db_seqs").alias("n"), F.max("db_letters").alias("l")).collect()]
    if len({tuple(h[c] for c in same) for h in heads}) > 1:
        raise ValueError(f"the archives {', '.join(paths)} differ in their matrix, penalties or statistics; their scores cannot be compared")
    sequences, letters = sum(h["n"] for h in heads), sum(h["l"] for h in heads)
    lam, k = (heads[0]["lambda"], heads[0]["k"]) if heads else (0.0, 0.0)
    if heads:
        config = replace(config, matrix=heads[0]["matrix"], gap_open=heads[0]["gap_open"], gap_extend=heads[0]["gap_extend"], frameshift=heads[0]["shift"])
    found = postfilter.merged([daa.read_daa(spark, p) for p in paths])
    if config.dominance and heads:
        scored = postfilter.scored(found, letters, lam, k).withColumns({"doc_id": F.col("read_name"), "prot_id": F.col("subject")})
        found = postfilter.not_dominated(scored, config.dominance_overlap, config.dominance_score).select(found.columns)
    daa.write_daa(found, path, sequences, letters, config, lam, k)


def archived(spark, path: str) -> DataFrame:
    """The alignments of an archive, with bit scores and e-values by its own headers."""
    head = daa.read_headers(spark, path).agg(F.max("db_letters").alias("l"), F.max("lambda").alias("lam"), F.max("k").alias("k")).first()
    out = daa.read_daa(spark, path)
    if head["l"] is None:
        return postfilter.scored(out, 1, 1.0, 1.0).withColumns({"qseqid": F.col("read_name"), "sseqid": F.col("subject")})
    return postfilter.scored(out, head["l"], head["lam"], head["k"]).withColumns({"qseqid": F.col("read_name"), "sseqid": F.col("subject")})
