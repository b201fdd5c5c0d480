"""Finished alignments as tabular, pairwise and XML files.

All take the columns of ``search.blastx`` (or of an archive, sources/daa.py) with read and subject
under ``qseqid`` and ``sseqid``, ``evalue`` and ``bitscore``.  Starts count from 1; on the minus
strand the query runs from its higher to its lower place on the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequences import frame_of
from strandlake.operators.alignment import statistics

BLAST_TAB = ["qseqid", "sseqid", "pident", "length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send", "evalue", "bitscore"]
#: The columns of the extended table, in their order.
BLAST_TAB_EXTENDED = [
    "qseqid", "qlen", "sseqid", "slen", "qstart", "qend", "sstart", "send", "evalue", "bitscore", "score", "length", "pident", "nident", "mismatch", "positive",
    "gapopen", "gaps", "ppos", "qframe", "qseq", "sseq",
]
#: Columns of a block of pairwise text.
BLOCK = 60


def described(found: DataFrame) -> DataFrame:
    """Adds the alignment statistics and the names and places of the tabular formats."""
    plus = F.col("strand") == "+"
    q_first = F.when(plus, F.col("q_start")).otherwise(F.col("read_len") - 1 - F.col("q_start"))
    bare = lambda c: F.translate(c, "-/\\", "")
    return statistics(found).withColumns(
        {
            "qlen": F.col("read_len"),
            "slen": F.col("ref_len"),
            "qstart": q_first + 1,
            "qend": F.when(plus, F.col("q_stop")).otherwise(F.col("read_len") - F.col("q_stop") + 1),
            "sstart": F.col("r_start") + 1,
            "send": F.col("r_stop"),
            "positive": F.col("npos"),
            "qframe": frame_of(q_first, F.col("read_len"), plus),
            "qseq": bare("query_line"),
            "sseq": bare("subject_line"),
        }
    )


def blast_tab(found: DataFrame) -> DataFrame:
    """The twelve columns of tabular output."""
    return described(found).withColumn("bitscore", F.round("bitscore", 1)).select(*BLAST_TAB)


def blast_tab_extended(found: DataFrame) -> DataFrame:
    """The 22 columns of extended tabular output; the sequences are the aligned letters without gaps."""
    return described(found).select(*BLAST_TAB_EXTENDED)


def write_tab(rows: DataFrame, path: str) -> None:
    """Tab-separated columns, as they are."""
    rows.write.option("sep", "\t").csv(path)


def blocks(frame: str = "qframe") -> Column:
    """The lines of an alignment in blocks of BLOCK columns, with the places of their first and last letters."""
    # places go on by the letters of each block: three bases a letter, one less or more a shift
    letters = lambda c: f"length(translate({c}, '-/\\\\', ''))"
    bases = f"(3 * {letters('x.q')} - length(x.q) + length(replace(x.q, '/', '')) + length(x.q) - length(replace(x.q, '\\\\', '')))"
    cut = lambda c: f"substr({c}, k * {BLOCK} + 1, {BLOCK})"
    parts = f"transform(sequence(0, CAST((length(query_line) - 1) DIV {BLOCK} AS INT)), k -> struct({cut('query_line')} AS q, {cut('middle_line')} AS m, {cut('subject_line')} AS s))"
    way = f"CASE WHEN {frame} > 0 THEN 1 ELSE -1 END"
    line = (
        f"concat('\\nQuery ', lpad(CAST(a.q AS STRING), 7, ' '), ' ', x.q, ' ', CAST(a.q + ({way}) * ({bases} - 1) AS STRING), '\\n', repeat(' ', 14), x.m, "
        f"'\\nSbjct ', lpad(CAST(a.s AS STRING), 7, ' '), ' ', x.s, ' ', CAST(a.s + {letters('x.s')} - 1 AS STRING), '\\n')"
    )
    step = f"(a, x) -> struct(concat(a.t, {line}) AS t, a.q + ({way}) * {bases} AS q, a.s + {letters('x.s')} AS s)"
    return F.expr(f"aggregate({parts}, struct('' AS t, CAST(qstart AS BIGINT) AS q, CAST(sstart AS BIGINT) AS s), {step}, a -> a.t)")


def pairwise(found: DataFrame) -> DataFrame:
    """(qseqid, value): the text of each read, its alignments from the best on."""
    share = lambda n, p: F.format_string("%d/%d (%.2f%%)", n, "length", p)
    text = F.concat(
        F.format_string(">%s\nLength=%d\n\nScore = %.2f bits (%d),\tExpected = %.2e,\t\nIdentities = ", F.col("sseqid").cast("string"), "slen", "bitscore", "score", "evalue"),
        share("nident", "pident"), F.lit(",\tPositives = "), share("npos", "ppos"), F.lit(",\tGaps = "), share("gaps", "pgaps"),
        F.format_string(",\nFrame = %d\n", "qframe"), blocks(), F.lit("\n"),
    )
    rows = described(found).select("qseqid", "qlen", F.struct(-F.col("bitscore"), "sseqid", "qstart", text.alias("t")).alias("x"))
    each = rows.groupBy("qseqid", "qlen").agg(F.array_sort(F.collect_list("x")).alias("x"))
    head = F.format_string("Query=%s\n\nLength=%d\n\n", F.col("qseqid").cast("string"), "qlen")
    return each.select("qseqid", F.concat(head, F.array_join(F.expr("transform(x, y -> y.t)"), "")).alias("value"))


def write_pairwise(found: DataFrame, path: str) -> None:
    """Text files, ordered by read."""
    pairwise(found).repartitionByRange("qseqid").sortWithinPartitions("qseqid").select("value").write.text(path)


def iterations(found: DataFrame) -> DataFrame:
    """A row per read, in the nested elements of BLAST's XML: an Iteration with its Hits, each with its Hsps."""
    hsp = F.struct(
        F.col("bitscore").alias("Hsp_bit-score"), F.col("score").alias("Hsp_score"), F.col("evalue").alias("Hsp_evalue"),
        F.least("qstart", "qend").alias("Hsp_query-from"), F.greatest("qstart", "qend").alias("Hsp_query-to"),
        F.col("sstart").alias("Hsp_hit-from"), F.col("send").alias("Hsp_hit-to"), F.col("qframe").alias("Hsp_query-frame"), F.lit(0).alias("Hsp_hit-frame"),
        F.col("nident").alias("Hsp_identity"), F.col("npos").alias("Hsp_positive"), F.col("gaps").alias("Hsp_gaps"), F.col("length").alias("Hsp_align-len"),
        F.col("query_line").alias("Hsp_qseq"), F.col("subject_line").alias("Hsp_hseq"), F.col("middle_line").alias("Hsp_midline"),
    )
    rows = described(found).select("qseqid", "qlen", "sseqid", "slen", (-F.col("bitscore")).alias("far"), hsp.alias("h"))
    hits = rows.groupBy("qseqid", "qlen", "sseqid", "slen").agg(F.min("far").alias("far"), F.array_sort(F.collect_list(F.struct("far", "h"))).alias("h"))
    numbered = "transform(h, (x, k) -> struct(k + 1 AS `Hsp_num`, " + ", ".join(f"x.h.`{f}` AS `{f}`" for f in rows.schema["h"].dataType.names) + "))"
    name = F.col("sseqid").cast("string")
    hit = F.struct("far", name.alias("Hit_id"), name.alias("Hit_def"), name.alias("Hit_accession"), F.col("slen").alias("Hit_len"), F.struct(F.expr(numbered).alias("Hsp")).alias("Hit_hsps"))
    reads = hits.select("qseqid", "qlen", hit.alias("x")).groupBy("qseqid", "qlen").agg(F.array_sort(F.collect_list("x")).alias("x"))
    each = "transform(x, (y, k) -> struct(k + 1 AS `Hit_num`, " + ", ".join(f"y.`{f}` AS `{f}`" for f in ("Hit_id", "Hit_def", "Hit_accession", "Hit_len", "Hit_hsps")) + "))"
    query = F.col("qseqid").cast("string")
    return reads.select(
        query.alias("Iteration_query-ID"), query.alias("Iteration_query-def"), F.col("qlen").alias("Iteration_query-len"), F.struct(F.expr(each).alias("Hit")).alias("Iteration_hits")
    )


def write_blast_xml(found: DataFrame, path: str) -> None:
    """XML files of BlastOutput_iterations."""
    iterations(found).write.format("xml").option("rootTag", "BlastOutput_iterations").option("rowTag", "Iteration").save(path)
