"""FASTA files as DataFrames, and files of results.

Plain files are split by Hadoop's reader at record marks, so a file of any size is read in
parallel; compressed ones are read whole by one task each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, rank, id, seq): a record starts with a > at the start of a line; ids end at the first
    blank and begin with no >; sequences are joined lines in upper case."""
    rows = spark.read.option("lineSep", "\n>").text(path).filter("trim(value) NOT IN ('', '>')")
    # the first record of a file keeps its mark
    record = F.regexp_replace("value", r"^\s*>", "")
    step = rows.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("rank"), record.alias("r"))
    head = F.substring_index("r", "\n", 1)
    seq = F.regexp_replace(F.expr("substr(r, length(substring_index(r, '\n', 1)) + 1)"), r"\s", "")
    return step.select("file", "rank", F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.upper(seq).alias("seq"))


def first_of_names(reads: DataFrame, name: str = "id", rank: str = "rank") -> DataFrame:
    """One read per name, the first by rank; summed before the shuffle, so a common name is no hot group."""
    rest = [c for c in reads.columns if c != name]
    return reads.groupBy(name).agg(F.min_by(F.struct(*rest), rank).alias("_r")).select(name, "_r.*").select(*reads.columns)


def write_fasta(rows: DataFrame, path: str, name: str = "id", seq: str = "seq") -> None:
    rows.select(F.concat(F.lit(">"), name, F.lit("\n"), seq)).write.text(path)
