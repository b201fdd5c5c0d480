"""The protein index: suffixes by their three-letter prefix, sorted, as a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from strandlake.functions.sequences import reduced
from strandlake.operators import neighbours
from strandlake.tables import stored

#: Letters of a suffix in the index.
LONGEST = 100
#: Suffixes made at once.
PIECE = 1 << 15


def suffixes(proteins: DataFrame, longest: int = LONGEST, groups: dict[str, str] | None = None) -> DataFrame:
    """(prot_id, pos, prefix3, suffix): each position with three letters or more left; ``suffix``
    holds its first ``longest`` letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 16) for b in batches for k in range(0, b.num_rows, 16)):
            for row, aa in enumerate(batch.column(1).to_pylist()):
                for begin in range(0, len(aa) - 2, PIECE):
                    places = range(begin, min(begin + PIECE, len(aa) - 2))
                    owner = batch.column(0).take(pa.array(np.full(len(places), row)))
                    columns = [pa.array(places, pa.int32()), pa.array([aa[k : k + 3] for k in places], pa.string()), pa.array([aa[k : k + longest] for k in places], pa.string())]
                    yield pa.RecordBatch.from_arrays([owner, *columns], names=["prot_id", "pos", "prefix3", "suffix"])

    letters = proteins.filter(F.length("aa") >= 3).select("prot_id", reduced(F.col("aa"), groups).alias("aa"))
    new = [StructField("pos", IntegerType()), StructField("prefix3", StringType()), StructField("suffix", StringType())]
    return letters.mapInArrow(run, StructType([letters.schema["prot_id"], *new]))


def sorted_index(found: DataFrame) -> DataFrame:
    """Suffixes dealt by prefix and sorted, the order in which they are written."""
    return found.repartition("prefix3").sortWithinPartitions("prefix3", "suffix", "prot_id", "pos")


def sampled(found: DataFrame, proteins: DataFrame, p: int, q: int) -> DataFrame:
    """The suffixes that start at minimizers (:func:`minimizers`): about 2 in ``q`` - ``p`` + 2 of them.  A match of ``q``
    letters or more holds one; its letters to the left are found again when the seed is extended."""
    kept = minimizers(proteins, p, q).select("prot_id", F.col("pos").cast("int").alias("pos"))
    short = proteins.filter((F.length("aa") >= 3) & (F.length("aa") < q)).select("prot_id")
    return found.join(kept, ["prot_id", "pos"], "left_semi").union(found.join(short, "prot_id", "left_semi").select(found.columns))


def write_index(proteins: DataFrame, path: str, sampling: tuple[int, int] | None = None) -> None:
    """The sorted suffixes of all positions, or of those of minimizers (p, q), as a table."""
    found = suffixes(proteins)
    sorted_index(sampled(found, proteins, *sampling) if sampling else found).write.parquet(path)


def lcp_neighbours(found: DataFrame, longest: int = 127, range_rows: int = neighbours.RANGE_ROWS) -> DataFrame:
    """Each suffix with the length of the prefix that it shares with its predecessor in the sorted order, 0 if
    that starts with other three letters.

    Ranges of the sorted order are sorted apart; the last suffix of each, a row a range, is carried to the next.
    """
    spark = found.sparkSession
    rows = stored(found.select("prot_id", "pos", F.substring("suffix", 1, longest).alias("suffix")), "suffixes")
    splits = spark.sparkContext.broadcast(neighbours.splits_of(rows, range_rows, longest))
    held = neighbours.ranged(rows, splits)
    lasts = {r["range"]: r["last"] for r in held.groupBy("range").agg(F.max("suffix").alias("last")).collect()}
    carried, before = {}, None
    for number in sorted(lasts):
        carried[number], before = before, lasts[number]
    sent = spark.sparkContext.broadcast(carried)

    def run(rows: pa.Table) -> pa.Table:
        prot, pos, suffix = rows.column("prot_id").to_numpy(), rows.column("pos").to_numpy(), neighbours.fixed(rows.column("suffix"), longest)
        order = np.lexsort((pos, prot, suffix))
        first = sent.value[rows.column("range")[0].as_py()] or ""
        letters = neighbours.letters_of(np.concatenate([np.array([first.encode()], suffix.dtype), suffix[order]]))
        lcp = neighbours.shared(letters[1:], letters[:-1])
        return pa.table({"prot_id": prot[order], "pos": pos[order], "lcp": np.where(lcp < 3, 0, lcp)})

    return held.groupBy("range").applyInArrow(run, "prot_id long, pos int, lcp long")


def minimizers(proteins: DataFrame, p: int = 3, q: int = 6) -> DataFrame:
    """Positions of the smallest ``p``-mer (by its sum of letter codes, the last of equals) of each window of ``q`` letters."""
    letters = proteins.filter(F.length("aa") >= q).select("prot_id", F.split("aa", "").alias("_a"))
    score = letters.withColumn("_s", F.expr(f"transform(sequence(0, size(_a) - {p}), i -> aggregate(slice(_a, i + 1, {p}), 0, (n, c) -> n + ascii(c)))"))
    width = q - p + 1
    window = f"transform(sequence(0, size(_s) - {width}), w -> array_min(transform(sequence(w, w + {width - 1}), i -> struct(_s[i] AS s, -i AS i))))"
    return score.select("prot_id", F.explode(F.array_distinct(F.expr(f"transform({window}, x -> -x.i)"))).alias("pos"))
