"""The registered search queries and DuckDB SQL for those that SQL can express.

The tables hold no sequences, so reads and proteins are derived from texts the same way in
both engines: a read is the letters a-z of a document, mapped to bases; a protein is the
frame-1 translation of a benchmark item's bases.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.config import long_reads, short_reads
from strandlake.functions import sequences, statistics
from strandlake.functions.sequences import CODONS
from strandlake.operators import alignment, chaining, extension, index, optimality, postfilter, replay, seeding
from strandlake.plans import search
from strandlake.sources import daa, results
from strandlake.sources.fasta import first_of_names

LETTERS = "abcdefghijklmnopqrstuvwxyz"
AS_BASES = ("ACGT" * 7)[:26]
K, M = 10, 10
#: Letters to both sides of a seed, scores of equal and other letters, and the drop of ``optimal_extensions``.
AROUND, MATCH, MISMATCH, DROP = 8, 6, -2, 12


def _dna(df: DataFrame) -> F.Column:
    return F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", ""), LETTERS, AS_BASES)


def reads(spark: SparkSession, d: str) -> DataFrame:
    docs = seeding.spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", _dna(docs).alias("dna"))


def proteins(spark: SparkSession, d: str) -> DataFrame:
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    return items.select(F.col("item_id").alias("prot_id"), _dna(items).alias("dna")).select("prot_id", sequences.translate("dna", 1).alias("aa"))


def _peptides(spark: SparkSession, d: str) -> DataFrame:
    return sequences.six_frames(reads(spark, d), keep=False)


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return seeding.seed_join(_peptides(spark, d), proteins(spark, d), K, M)


def revcomp(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("doc_id", F.md5(sequences.reverse_complement(F.col("dna"))).alias("rc_md5"), F.length("dna").cast("long").alias("n_bases"))


def translate_frame1(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("doc_id", F.md5(sequences.translate("dna", 1)).alias("aa_md5"))


def six_frame(spark: SparkSession, d: str) -> DataFrame:
    return _peptides(spark, d).select("doc_id", "frame", F.length("aa").cast("long").alias("n_aa"), F.md5("aa").alias("aa_md5"))


def pack_dna(spark: SparkSession, d: str) -> DataFrame:
    """Reads as two bits a base, as archives hold them."""

    @F.pandas_udf("binary")
    def packed(dna: pd.Series) -> pd.Series:
        return dna.map(daa.packed_bases)

    return reads(spark, d).select("doc_id", F.md5(F.hex(packed("dna"))).alias("packed_md5"))


def reduce_alphabet(spark: SparkSession, d: str) -> DataFrame:
    groups = {"I": "L", "V": "L", "M": "L", "D": "E", "K": "R"}
    return proteins(spark, d).select("prot_id", sequences.reduced(F.col("aa"), groups).alias("reduced"))


def seq_stats(spark: SparkSession, d: str) -> DataFrame:
    base = proteins(spark, d).agg(F.count("*").alias("n_seqs"), F.sum(F.length("aa")).alias("n_letters"), F.max(F.length("aa")).cast("long").alias("longest"))
    return base


def ka_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of all reads with the statistics of one penalty row: bits that an expected score 1 needs."""
    row = statistics.ka_table(spark).filter("matrix = 'BLOSUM80' AND gap_open = 11 AND gap_extend = 2")
    return reads(spark, d).select("doc_id", F.length("dna").cast("long").alias("n_bases")).withColumns({c: row.select(c).scalar() for c in ("lambda", "k", "h")})


def min_seed_score(spark: SparkSession, d: str) -> DataFrame:
    lam, k, _ = statistics.ka("BLOSUM80", 11, 2)
    letters = proteins(spark, d).agg(F.sum(F.length("aa")).alias("letters")).scalar()
    rows = reads(spark, d).select("doc_id", F.length("dna").alias("n")).filter("n > 0").withColumn("letters", letters)
    return rows.select("doc_id", statistics.min_seed_score(F.col("n"), F.col("letters"), lam, k).alias("min_score"))


def prefix_histogram(spark: SparkSession, d: str) -> DataFrame:
    return index.suffixes(proteins(spark, d)).groupBy("prefix3").agg(F.count("*").alias("n"))


def suffixes(spark: SparkSession, d: str) -> DataFrame:
    return index.suffixes(proteins(spark, d)).select("prot_id", F.col("pos").cast("long").alias("pos"), "suffix")


def lcp_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return index.lcp_neighbours(index.suffixes(proteins(spark, d), 127)).select("prot_id", F.col("pos").cast("long").alias("pos"), "lcp")


def minimizers(spark: SparkSession, d: str) -> DataFrame:
    return index.minimizers(proteins(spark, d)).select("prot_id", F.col("pos").cast("long").alias("pos"))


def seed_join_k(spark: SparkSession, d: str) -> DataFrame:
    return _seeds(spark, d).groupBy("doc_id", "frame", "prot_id", (F.col("q_pos") - F.col("r_pos")).cast("long").alias("diag")).agg(F.count("*").alias("n_seeds"))


def adaptive_seed_join(spark: SparkSession, d: str) -> DataFrame:
    peptides = _peptides(spark, d).select((F.col("doc_id") * 8 + F.col("frame") + 3).alias("q_id"), "aa")
    return extension.seed_counts(peptides, proteins(spark, d), M)


def ungapped_xdrop(spark: SparkSession, d: str) -> DataFrame:
    """Adaptive seeds after their ungapped extension to both sides."""
    return search.seeds(reads(spark, d), proteins(spark, d), long_reads())


def diagonal_suppress(spark: SparkSession, d: str) -> DataFrame:
    out = seeding.suppress_covered(_seeds(spark, d), K)
    return out.select("doc_id", "frame", "prot_id", F.col("q_pos").cast("long").alias("q_pos"), F.col("r_pos").cast("long").alias("r_pos"))


def diagonal_window_best(spark: SparkSession, d: str) -> DataFrame:
    return chaining.diagonal_windows(_seeds(spark, d), proteins(spark, d)).select("doc_id", "strand", "prot_id", "n_seeds", "y")


def strand_choice(spark: SparkSession, d: str) -> DataFrame:
    return chaining.strand_choice(chaining.diagonal_windows(_seeds(spark, d), proteins(spark, d))).select("doc_id", "prot_id", "strand", "n_seeds", "y")


def linear_chain(spark: SparkSession, d: str) -> DataFrame:
    return search.chains(reads(spark, d), proteins(spark, d), long_reads())


def frameshift_blastx(spark: SparkSession, d: str) -> DataFrame:
    out = search.blastx(reads(spark, d), proteins(spark, d), long_reads())
    return out.select("doc_id", "prot_id", "strand", "score", "q_start", "q_stop", "r_start", "r_stop", F.expr(alignment.encoded()).alias("edits"), F.round("bitscore", 3).alias("bitscore"))


def gapped_blastx(spark: SparkSession, d: str) -> DataFrame:
    out = search.blastx(reads(spark, d), proteins(spark, d), short_reads())
    return out.select("doc_id", "prot_id", "strand", "score", "q_start", "q_stop", "r_start", "r_stop", F.expr(alignment.encoded()).alias("edits"), F.round("bitscore", 3).alias("bitscore"))


def alignment_stats(spark: SparkSession, d: str) -> DataFrame:
    out = alignment.statistics(search.blastx(reads(spark, d), proteins(spark, d)))
    return out.select("doc_id", "prot_id", "length", "nident", "mismatch", "gaps", "gapopen", "frameshifts", "pident")


def blast_tab(spark: SparkSession, d: str) -> DataFrame:
    return results.blast_tab(_named(search.blastx(reads(spark, d), proteins(spark, d))))


def blast_tab_extended(spark: SparkSession, d: str) -> DataFrame:
    return results.blast_tab_extended(_named(search.blastx(reads(spark, d), proteins(spark, d))))


def _named(found: DataFrame) -> DataFrame:
    return found.withColumnsRenamed({"doc_id": "qseqid", "prot_id": "sseqid"})


def dominance_filter(spark: SparkSession, d: str) -> DataFrame:
    out = search.blastx(reads(spark, d), proteins(spark, d), long_reads(dominance=True))
    return out.select("doc_id", "prot_id", "strand", "q_start", "q_stop", F.round("bitscore", 3).alias("bitscore"))


def subject_ids(spark: SparkSession, d: str) -> DataFrame:
    return postfilter.subject_ids(_seeds(spark, d)).select("prot_id", "name", "subject")


def query_skip(spark: SparkSession, d: str) -> DataFrame:
    """The k-mer seeds that a walk over each peptide takes."""
    found = _seeds(spark, d).withColumns({"length": F.lit(K), "at": F.col("q_pos"), "match": F.lit(K)})
    out = replay.query_skip(found)
    return out.select("doc_id", "frame", "prot_id", F.col("q_pos").cast("long").alias("q_pos"), F.col("r_pos").cast("long").alias("r_pos"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return chaining.merged(_seeds(spark, d).withColumns({"length": F.lit(K), "score": F.lit(K)}))


def seed_merge(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).drop("score")


def dominance_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Merged seeds, by their letters, over which no other of the read lies with clearly more."""
    rows = _merged(spark, d).withColumn("bitscore", (F.col("r_stop") - F.col("r_start")).cast("double"))
    return postfilter.not_dominated(rows).select("doc_id", "prot_id", "strand", "frame", "q_start", "q_stop", "bitscore")


def optimal_extensions(spark: SparkSession, d: str) -> DataFrame:
    """Each k-mer seed with the letters around it: the sum of its pairs' scores, and whether that is worth its whole length."""
    found = _seeds(spark, d)
    texts = found.join(_peptides(spark, d), ["doc_id", "frame"]).join(proteins(spark, d).withColumnRenamed("aa", "r_aa"), "prot_id")
    left = F.least(F.lit(AROUND), "q_pos", "r_pos")
    letters = left + K + F.least(F.lit(AROUND), F.length("aa") - F.col("q_pos") - K, F.length("r_aa") - F.col("r_pos") - K)
    pieces = [F.split(F.substring(aa, F.col(pos) - left + 1, letters), "") for aa, pos in (("aa", "q_pos"), ("r_aa", "r_pos"))]
    steps = F.zip_with(*pieces, lambda a, b: F.when((a == b) & ~a.isin("X", "*"), F.lit(MATCH)).otherwise(F.lit(MISMATCH)))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)
    best = optimality.optimal_extension(steps, DROP)
    return texts.select("doc_id", "frame", "prot_id", F.col("q_pos").cast("long").alias("q_pos"), F.col("r_pos").cast("long").alias("r_pos"), total.alias("total"), best.alias("optimal"))


def planted_reads(spark: SparkSession, d: str) -> DataFrame:
    """A read for each benchmark item: its bases with one more in the middle (a frame shift), the next
    item's on the other strand, and half of its own again (a repeat)."""
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    items = items.select("item_id", _dna(items).alias("b"))
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("b").alias("n"))
    half = F.expr("length(b) div 2")
    dna = F.concat(F.substring(F.col("b"), F.lit(1), half), F.lit("A"), F.expr("substr(b, length(b) div 2 + 1)"), sequences.reverse_complement(F.coalesce("n", F.lit(""))), F.substring(F.col("b"), F.lit(1), half))
    return items.join(after, "item_id", "left").select(F.col("item_id").alias("doc_id"), dna.alias("dna"))


def planted_proteins(spark: SparkSession, d: str) -> DataFrame:
    """The proteins of the items, and the middle third of each as a rival of its own."""
    whole = proteins(spark, d)
    third = F.expr("substr(aa, length(aa) div 3 + 1, length(aa) div 3)")
    return whole.select((2 * F.col("prot_id")).alias("prot_id"), "aa").union(whole.select((2 * F.col("prot_id") + 1).alias("prot_id"), third.alias("aa")))


def _planted_seeds(spark: SparkSession, d: str) -> DataFrame:
    peptides = sequences.six_frames(seeding.spread(planted_reads(spark, d))).drop("dna")
    found = seeding.seed_join(peptides, planted_proteins(spark, d), K, M)
    return found.withColumns({"length": F.lit(K), "score": F.lit(K), "at": F.col("q_pos"), "match": F.lit(K)})


def planted_adaptive_seeds(spark: SparkSession, d: str) -> DataFrame:
    peptides = sequences.six_frames(seeding.spread(planted_reads(spark, d))).select((F.col("doc_id") * 8 + F.col("frame") + 3).alias("prot_id"), "aa")
    query = index.suffixes(peptides, seeding.LONGEST).select(F.col("prot_id").alias("q_id"), F.col("pos").alias("q_pos"), "suffix")
    out = seeding.adaptive_seed_join(query, index.suffixes(planted_proteins(spark, d), seeding.LONGEST), M, small_partitions=True)
    return out.select("q_id", F.col("q_pos").cast("long").alias("q_pos"), "prot_id", F.col("pos").cast("long").alias("pos"), "len")


def planted_ungapped(spark: SparkSession, d: str) -> DataFrame:
    """Adaptive seeds of the planted reads, extended to both sides."""
    out = search.seeds(planted_reads(spark, d), planted_proteins(spark, d), long_reads())
    return out.select("doc_id", "frame", "prot_id", *(F.col(c).cast("long").alias(c) for c in ("q_pos", "r_pos", "length", "score")))


def planted_chains(spark: SparkSession, d: str) -> DataFrame:
    """Linear chains of the planted reads' seeds on their better strand."""
    return search.chains(planted_reads(spark, d), planted_proteins(spark, d), long_reads()).drop("seeds")


def seed_evalues(spark: SparkSession, d: str) -> DataFrame:
    """Bit scores, coverages and the logarithms of both e-values of the planted reads' merged seeds."""
    lam, k, _ = statistics.ka("BLOSUM62", 11, 1)
    letters = planted_proteins(spark, d).agg(F.sum(F.length("aa")).alias("letters")).scalar()
    lengths = planted_reads(spark, d).select("doc_id", F.length("dna").alias("read_len"))
    whole = planted_proteins(spark, d).select("prot_id", F.length("aa").alias("ref_len"))
    rows = chaining.merged(_planted_seeds(spark, d)).join(lengths, "doc_id").join(whole, "prot_id").withColumn("score", MATCH * (F.col("r_stop") - F.col("r_start")))
    log = lambda x: F.round(F.log10(x), 6)
    return rows.select(
        "doc_id", "prot_id", "strand", "q_start", F.round(statistics.bit_score(F.col("score"), lam, k), 6).alias("bits"), log(statistics.evalue(F.col("score"), F.col("read_len"), letters, lam, k)).alias("log_evalue"),
        log(statistics.evalue_of_fixed_space(F.col("score"), lam, k)).alias("log_evalue_fixed"), statistics.coverage(F.col("r_stop") - F.col("r_start"), F.col("ref_len")).cast("long").alias("coverage"),
    )


def planted_skip(spark: SparkSession, d: str) -> DataFrame:
    out = replay.query_skip(_planted_seeds(spark, d))
    return out.select("doc_id", "frame", "prot_id", F.col("q_pos").cast("long").alias("q_pos"), F.col("r_pos").cast("long").alias("r_pos"))


def planted_merge(spark: SparkSession, d: str) -> DataFrame:
    return chaining.merged(_planted_seeds(spark, d)).drop("score")


def planted_dominance(spark: SparkSession, d: str) -> DataFrame:
    rows = chaining.merged(_planted_seeds(spark, d)).withColumn("bitscore", (F.col("r_stop") - F.col("r_start")).cast("double"))
    return postfilter.not_dominated(rows).select("doc_id", "prot_id", "strand", "frame", "q_start", "q_stop", "bitscore")


def dedupe_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads named by their source and length: the first of each name stays."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    named = docs.select(F.concat_ws("-", "source", F.length("text").cast("string")).alias("id"), F.col("doc_id").alias("rank"))
    return first_of_names(named)


def run_counters(spark: SparkSession, d: str) -> DataFrame:
    n = reads(spark, d).agg(F.count("*").alias("n_reads"), F.sum(F.length("dna")).alias("n_bases"))
    p = proteins(spark, d).agg(F.count("*").alias("n_proteins"), F.sum(F.length("aa")).alias("n_letters"))
    return n.withColumns({c: p.select(c).scalar() for c in p.columns})


_MAP = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in CODONS.items()) + "}"
_AA = "array_to_string(list_transform(regexp_extract_all({0}, '...'), lambda c: cod[c]), '')"
_BASES = f"translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{LETTERS}', '{AS_BASES}')"
_READS = f"cods AS (SELECT {_MAP} AS cod), reads AS (SELECT doc_id, {_BASES} AS dna FROM documents)"
_PROT = f"prot AS (SELECT item_id AS prot_id, {_AA.format('dna')} AS aa FROM (SELECT item_id, {_BASES} AS dna FROM benchmark), cods)"
_SIX = (
    "strands AS (SELECT doc_id, 1 AS s, dna FROM reads UNION ALL SELECT doc_id, -1, translate(reverse(dna), 'ACGT', 'TGCA') FROM reads), "
    f"pep AS (SELECT doc_id, CAST(s * f AS INT) AS frame, {_AA.format('substr(dna, f)')} AS aa FROM strands, range(1, 4) r(f), cods)"
)
_SUF = "suf AS (SELECT prot_id, pos, substr(aa, pos + 1, {0}) AS suffix FROM (SELECT prot_id, aa, unnest(range(greatest(length(aa) - 2, 0))) AS pos FROM prot))"
_LCP = "len(list_filter(range(1, 128), lambda i: i <= least(length({0}), length({1})) AND {0}[1:i] = {1}[1:i]))"
_SEEDS = f"""rk AS (SELECT prot_id, pos, substr(aa, pos + 1, {K}) AS kmer FROM (SELECT prot_id, aa, unnest(range(greatest(length(aa) - {K - 1}, 0))) AS pos FROM prot)),
rn AS (SELECT *, count(*) OVER (PARTITION BY kmer) AS n, row_number() OVER (PARTITION BY kmer ORDER BY prot_id, pos) AS k FROM rk),
qk AS (SELECT doc_id, frame, pos AS q_pos, substr(aa, pos + 1, {K}) AS kmer FROM (SELECT doc_id, frame, aa, unnest(range(greatest(length(aa) - {K - 1}, 0))) AS pos FROM pep)),
seeds AS (SELECT doc_id, frame, prot_id, q_pos, pos AS r_pos FROM qk JOIN (SELECT * FROM rn WHERE n <= {M} OR k = 1) USING (kmer))"""
_ALL = f"WITH {_READS}, {_PROT}, {_SIX}, {_SEEDS}"
_WIN = """lens AS (SELECT prot_id, length(aa) AS ref_len FROM prot),
pts AS (SELECT doc_id, prot_id, CASE WHEN frame > 0 THEN '+' ELSE '-' END AS strand, 3 * q_pos + abs(frame) - 1 - 3 * r_pos + 3 * ref_len AS y,
               CAST(greatest(0.06 * 3 * ref_len, 10.0) AS DOUBLE) AS width FROM seeds JOIN lens USING (prot_id)),
cnt AS (SELECT *, count(*) OVER (PARTITION BY doc_id, strand, prot_id ORDER BY y / width RANGE BETWEEN CURRENT ROW AND 1.0 FOLLOWING) AS n FROM pts),
win AS (SELECT doc_id, strand, prot_id, n AS n_seeds, CAST(y AS BIGINT) AS y FROM cnt QUALIFY row_number() OVER (PARTITION BY doc_id, strand, prot_id ORDER BY n DESC, y) = 1)"""

_IN_GROUP = "WINDOW w AS (PARTITION BY doc_id, prot_id, m ORDER BY isle)"
_ROUND = f"SELECT * FROM {{0}} {_IN_GROUP} QUALIFY NOT coalesce(a >= lag(a) OVER w AND b <= lag(b) OVER w AND ra >= lag(ra) OVER w AND rb <= lag(rb) OVER w, false)"
_MERGED = f"""placed AS (SELECT *, frame < 0 AS m, 3 * q_pos + abs(frame) - 1 AS nt FROM seeds),
linked AS (SELECT *, CASE WHEN lag(frame) OVER w = frame AND nt - lag(nt) OVER w = 3 * (r_pos - lag(r_pos) OVER w) AND nt - lag(nt) OVER w < {3 * K} THEN 0 ELSE 1 END AS new FROM placed
           WINDOW w AS (PARTITION BY doc_id, prot_id, m ORDER BY nt, r_pos, frame)),
isles AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, prot_id, m ORDER BY nt, r_pos, frame ROWS UNBOUNDED PRECEDING) AS isle FROM linked),
g0 AS (SELECT doc_id, prot_id, m, isle, any_value(frame) AS frame, min(nt) AS a, min(nt) + 3 * (max(r_pos) - min(r_pos) + {K}) AS b, min(r_pos) AS ra, max(r_pos) + {K} AS rb FROM isles GROUP BY 1, 2, 3, 4),
g1 AS ({_ROUND.format('g0')}), g2 AS ({_ROUND.format('g1')}), g3 AS ({_ROUND.format('g2')}), g4 AS ({_ROUND.format('g3')}),
cut AS (SELECT *, least((greatest(coalesce(lag(b) OVER w, 0) - a, 0) + 2) // 3 * 3, b - a) AS c FROM g4 {_IN_GROUP}),
merged AS (SELECT doc_id, prot_id, CASE WHEN m THEN '-' ELSE '+' END AS strand, frame, CAST(a + c AS BIGINT) AS q_start, CAST(b AS BIGINT) AS q_stop, CAST(ra + c // 3 AS BIGINT) AS r_start, CAST(rb AS BIGINT) AS r_stop FROM cut WHERE a + c < b)"""

_WALK = f""", pos AS (SELECT DISTINCT doc_id, frame, q_pos FROM seeds),
nxt AS (SELECT a.doc_id, a.frame, a.q_pos, min(b.q_pos) AS n FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.frame = b.frame AND b.q_pos > a.q_pos + {K} GROUP BY 1, 2, 3),
walk AS (SELECT doc_id, frame, min(q_pos) AS q_pos FROM pos GROUP BY 1, 2 UNION ALL SELECT walk.doc_id, walk.frame, n FROM walk JOIN nxt ON walk.doc_id = nxt.doc_id AND walk.frame = nxt.frame AND walk.q_pos = nxt.q_pos)
SELECT s.doc_id, s.frame, prot_id, s.q_pos, r_pos FROM seeds s JOIN walk ON s.doc_id = walk.doc_id AND s.frame = walk.frame AND s.q_pos = walk.q_pos"""
_DOMINANCE = """, h AS (SELECT *, CAST(r_stop - r_start AS DOUBLE) AS bitscore FROM merged)
SELECT doc_id, prot_id, strand, frame, q_start, q_stop, bitscore FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.doc_id = h.doc_id
  AND least(o.q_stop, h.q_stop) - greatest(o.q_start, h.q_start) > 0.9 * (h.q_stop - h.q_start) AND 0.9 * o.bitscore > h.bitscore)"""
_PLANTED = f"""WITH RECURSIVE cods AS (SELECT {_MAP} AS cod), items AS (SELECT item_id, {_BASES} AS b FROM benchmark),
reads AS (SELECT i.item_id AS doc_id, substr(i.b, 1, length(i.b) // 2) || 'A' || substr(i.b, length(i.b) // 2 + 1) || translate(reverse(coalesce(n.b, '')), 'ACGT', 'TGCA') || substr(i.b, 1, length(i.b) // 2) AS dna
          FROM items i LEFT JOIN items n ON n.item_id = i.item_id + 1),
one AS (SELECT item_id, {_AA.format('b')} AS aa FROM items, cods),
prot AS (SELECT 2 * item_id AS prot_id, aa FROM one UNION ALL SELECT 2 * item_id + 1, substr(aa, length(aa) // 3 + 1, length(aa) // 3) FROM one), {_SIX}"""
#: Common prefixes of pairs of suffixes, by halves: n letters are known to be alike, then s more.
_HALVES = "\n".join(f"l{k + 1} AS (SELECT * REPLACE (n + CASE WHEN least(length(a), length(b)) >= n + {s} AND substr(a, n + 1, {s}) = substr(b, n + 1, {s}) THEN {s} ELSE 0 END AS n) FROM l{k})," for k, s in enumerate((64, 32, 16, 8, 4, 2, 1)))
_ADAPTIVE = f"""{_PLANTED}, suf AS (SELECT prot_id, pos, substr(aa, pos + 1, 100) AS b FROM (SELECT prot_id, aa, unnest(range(greatest(length(aa) - 2, 0))) AS pos FROM prot)),
qs AS (SELECT doc_id * 8 + frame + 3 AS q_id, q_pos, substr(aa, q_pos + 1, 100) AS a FROM (SELECT doc_id, frame, aa, unnest(range(greatest(length(aa) - 2, 0))) AS q_pos FROM pep)),
few AS (SELECT b[1:3] AS p FROM suf GROUP BY 1 HAVING count(*) <= {M}),
l0 AS (SELECT q_id, q_pos, prot_id, pos, a, b, 0 AS n FROM qs JOIN suf ON length(a) >= 4 AND a[1:4] = b[1:4] AND length(b) >= 4 AND a[1:3] NOT IN (SELECT p FROM few)),
{_HALVES}
best AS (SELECT *, count(*) OVER w AS many, row_number() OVER (w ORDER BY prot_id, pos) AS k FROM (SELECT * FROM l7 QUALIFY n = max(n) OVER (PARTITION BY q_id, q_pos)) WINDOW w AS (PARTITION BY q_id, q_pos))
SELECT q_id, q_pos, prot_id, pos, CAST(n AS BIGINT) AS len FROM best WHERE many <= {M} OR k = 1
UNION ALL SELECT q_id, q_pos, prot_id, pos, 3 FROM qs JOIN suf ON a[1:3] = b[1:3] JOIN few ON a[1:3] = p"""

_LAM, _K, _ = map(float, statistics.ungapped(alignment.score_table(None, MATCH, MISMATCH)))
_SIDE = "min(k) FILTER (m - c >= {0}) AS stop_{1}"
_BEST = "max(m) FILTER (k <= coalesce(stop_{0}, k)) AS best_{0}"
_UNGAPPED = _ADAPTIVE.replace("SELECT q_id, q_pos, prot_id, pos, CAST(n AS BIGINT)", ", hits AS (SELECT q_id, q_pos, prot_id, pos, CAST(n AS BIGINT)") + f"""),
texts AS (SELECT h.q_id, h.q_pos AS i, h.prot_id, h.pos AS j, pep.aa AS q, prot.aa AS r, pep.doc_id, pep.frame,
                 CAST(floor((ln(length(pep.aa) * CAST(t.letters AS DOUBLE) * {_K!r}) - {statistics.SEED_EXPECTATION}) / {_LAM!r} + 0.5) AS BIGINT) AS least
          FROM hits h JOIN pep ON h.q_id = pep.doc_id * 8 + pep.frame + 3 JOIN prot USING (prot_id), (SELECT sum(length(aa)) AS letters FROM prot) t),
pairs AS (SELECT *, 0 AS side, unnest(range(0, least(i, j) + 1)) AS k FROM texts UNION ALL SELECT *, 1, unnest(range(0, least(length(q) - i, length(r) - j) - 1)) FROM texts),
steps AS (SELECT *, CASE WHEN a = b AND a NOT IN ('X', '*') THEN {MATCH} ELSE {MISMATCH} END AS s
          FROM (SELECT *, CASE WHEN side = 0 THEN q[i - k + 1] ELSE q[i + k + 2] END AS a, CASE WHEN side = 0 THEN r[j - k + 1] ELSE r[j + k + 2] END AS b FROM pairs)),
sums AS (SELECT *, sum(s) OVER w AS c FROM steps WINDOW w AS (PARTITION BY q_id, i, prot_id, j, side ORDER BY k)),
tops AS (SELECT *, greatest(0, max(c) OVER (PARTITION BY q_id, i, prot_id, j, side ORDER BY k)) AS m FROM sums),
stops AS (SELECT q_id, i, prot_id, j, side, {_SIDE.format(round(10 / _LAM), 1)}, {_SIDE.format("CAST(round_even(least * 0.1, 0) AS BIGINT)", 2)} FROM tops GROUP BY ALL),
bests AS (SELECT q_id, i, prot_id, j, side, stop_2, {_BEST.format(1)}, {_BEST.format(2)} FROM tops JOIN stops USING (q_id, i, prot_id, j, side) GROUP BY ALL),
ends AS (SELECT b.q_id, b.i, b.prot_id, b.j, b.side, best_1, best_2, coalesce(min(k + 1) FILTER (c = best_2 AND best_2 > 0), 0) AS n FROM tops t JOIN bests b USING (q_id, i, prot_id, j, side) GROUP BY ALL),
both_sides AS (SELECT q_id, i, prot_id, j, sum(best_1) AS s1, sum(best_2) AS s2, greatest(max(n) FILTER (side = 0), 1) AS n0, coalesce(max(n) FILTER (side = 1), 0) AS n1 FROM ends GROUP BY 1, 2, 3, 4)
SELECT DISTINCT doc_id, frame, prot_id, CAST(i - n0 + 1 AS BIGINT) AS q_pos, CAST(j - n0 + 1 AS BIGINT) AS r_pos, CAST(n0 + n1 AS BIGINT) AS length, CAST(s2 AS BIGINT) AS score
FROM both_sides JOIN texts USING (q_id, i, prot_id, j) WHERE s1 >= least"""

_CHAINS = _UNGAPPED.replace("\nSELECT DISTINCT doc_id, frame", ",\nseeds AS (SELECT DISTINCT doc_id, frame") + """),
pts AS (SELECT doc_id, prot_id, frame < 0 AS m, 3 * q_pos + abs(frame) - 1 AS nt, r_pos AS r, s.length AS n, score, nt - 3 * r + 3 * length(aa) AS y, CAST(greatest(0.06 * 3 * length(aa), 10.0) AS DOUBLE) AS width FROM seeds s JOIN prot USING (prot_id)),
starts AS (SELECT DISTINCT doc_id, prot_id, m, y, width FROM pts),
weights AS (SELECT a.doc_id, a.prot_id, a.m, a.y, a.width, sum(b.score) AS weight FROM starts a JOIN pts b ON a.doc_id = b.doc_id AND a.prot_id = b.prot_id AND a.m = b.m AND b.y BETWEEN a.y AND a.y + a.width GROUP BY ALL),
heaviest AS (SELECT doc_id, prot_id, m, y AS y0, width AS w0 FROM weights QUALIFY row_number() OVER (PARTITION BY doc_id, prot_id ORDER BY weight DESC, m, y) = 1),
members AS (SELECT doc_id, prot_id, m, nt, r, n, row_number() OVER (PARTITION BY doc_id, prot_id ORDER BY score DESC, nt, r, n) AS k FROM pts JOIN heaviest USING (doc_id, prot_id, m) WHERE y BETWEEN y0 AND y0 + w0),
line AS (SELECT doc_id, prot_id, m, k, [{'nt': nt, 'r': r, 'n': n}] AS kept FROM members WHERE k = 1
         UNION ALL SELECT x.doc_id, x.prot_id, x.m, x.k, CASE WHEN len(list_filter(kept, lambda o: CASE WHEN (o.nt, o.r, o.n) <= (x.nt, x.r, x.n) THEN o.r > x.r ELSE o.r < x.r END)) = 0
                   THEN list_append(kept, {'nt': x.nt, 'r': x.r, 'n': x.n}) ELSE kept END FROM line JOIN members x ON x.doc_id = line.doc_id AND x.prot_id = line.prot_id AND x.k = line.k + 1)
SELECT doc_id, prot_id, CASE WHEN m THEN '-' ELSE '+' END AS strand, CAST(list_min(list_transform(kept, lambda x: x.nt)) AS BIGINT) AS start, CAST(list_max(list_transform(kept, lambda x: x.nt + 3 * x.n)) AS BIGINT) AS stop,
       CAST(list_min(list_transform(kept, lambda x: x.r)) AS BIGINT) AS r_start, CAST(list_max(list_transform(kept, lambda x: x.r + x.n)) AS BIGINT) AS r_stop, CAST(len(kept) AS BIGINT) AS n
FROM line QUALIFY k = max(k) OVER (PARTITION BY doc_id, prot_id)"""

ORACLES = {
    "revcomp": f"WITH {_READS} SELECT doc_id, md5(translate(reverse(dna), 'ACGT', 'TGCA')) AS rc_md5, CAST(length(dna) AS BIGINT) AS n_bases FROM reads",
    "translate_frame1": f"WITH {_READS} SELECT doc_id, md5({_AA.format('dna')}) AS aa_md5 FROM reads, cods",
    "six_frame": f"WITH {_READS}, {_SIX} SELECT doc_id, frame, CAST(length(aa) AS BIGINT) AS n_aa, md5(aa) AS aa_md5 FROM pep",
    "pack_dna": f"WITH {_READS} SELECT doc_id, md5(coalesce(array_to_string(list_transform(regexp_extract_all(dna || 'AAA', '....'), lambda g: printf('%02X', instr('ACGT', g[1]) - 1 + 4 * (instr('ACGT', g[2]) - 1) + 16 * (instr('ACGT', g[3]) - 1) + 64 * (instr('ACGT', g[4]) - 1))), ''), '')) AS packed_md5 FROM reads",
    "reduce_alphabet": f"WITH {_READS}, {_PROT} SELECT prot_id, translate(aa, 'IVMDK', 'LLLER') AS reduced FROM prot",
    "seq_stats": f"WITH {_READS}, {_PROT} SELECT count(*) AS n_seqs, CAST(sum(length(aa)) AS BIGINT) AS n_letters, CAST(max(length(aa)) AS BIGINT) AS longest FROM prot",
    "ka_lookup": f"WITH {_READS} SELECT doc_id, CAST(length(dna) AS BIGINT) AS n_bases, CAST(0.365249 AS DOUBLE) AS lambda, CAST(0.168504 AS DOUBLE) AS k, CAST(0.35 AS DOUBLE) AS h FROM reads",
    "min_seed_score": f"WITH {_READS}, {_PROT}, t AS (SELECT sum(length(aa)) AS letters FROM prot) SELECT doc_id, CAST(round((ln(CAST(length(dna) * letters AS DOUBLE) * 0.168504) - 1.52718) / 0.365249) AS BIGINT) AS min_score FROM reads, t WHERE length(dna) > 0",
    "prefix_histogram": f"WITH {_READS}, {_PROT}, {_SUF.format(100)} SELECT suffix[1:3] AS prefix3, count(*) AS n FROM suf GROUP BY 1",
    "suffixes": f"WITH {_READS}, {_PROT}, {_SUF.format(100)} SELECT prot_id, pos, suffix FROM suf",
    "lcp_neighbours": f"WITH {_READS}, {_PROT}, {_SUF.format(127)}, b AS (SELECT *, lag(suffix) OVER (PARTITION BY suffix[1:3] ORDER BY suffix, prot_id, pos) AS p FROM suf) SELECT prot_id, pos, CASE WHEN p IS NULL THEN 0 ELSE {_LCP.format('suffix', 'p')} END AS lcp FROM b",
    "minimizers": f"WITH {_READS}, {_PROT}, s AS (SELECT prot_id, pos, ascii(aa[pos + 1]) + ascii(aa[pos + 2]) + ascii(aa[pos + 3]) AS s FROM (SELECT prot_id, aa, unnest(range(greatest(length(aa) - 2, 0))) AS pos FROM prot WHERE length(aa) >= 6)), w AS (SELECT a.prot_id, a.pos AS w, b.pos, b.s FROM s a JOIN s b ON a.prot_id = b.prot_id AND b.pos BETWEEN a.pos AND a.pos + 3 QUALIFY count(*) OVER (PARTITION BY a.prot_id, a.pos) = 4) SELECT DISTINCT prot_id, pos FROM (SELECT prot_id, pos FROM w QUALIFY row_number() OVER (PARTITION BY prot_id, w ORDER BY s, pos DESC) = 1)",
    "seed_join_k": f"{_ALL} SELECT doc_id, frame, prot_id, q_pos - r_pos AS diag, count(*) AS n_seeds FROM seeds GROUP BY 1, 2, 3, 4",
    "diagonal_suppress": f"{_ALL} SELECT doc_id, frame, prot_id, q_pos, r_pos FROM (SELECT *, lag(q_pos) OVER (PARTITION BY doc_id, frame, prot_id, q_pos - r_pos ORDER BY q_pos) + {K} AS e FROM seeds) WHERE e IS NULL OR q_pos > e",
    "diagonal_window_best": f"{_ALL}, {_WIN} SELECT doc_id, strand, prot_id, n_seeds, y FROM win",
    "strand_choice": f"{_ALL}, {_WIN} SELECT doc_id, prot_id, strand, n_seeds, y FROM win QUALIFY row_number() OVER (PARTITION BY doc_id, prot_id ORDER BY n_seeds DESC, strand = '+' DESC) = 1",
    "subject_ids": f"{_ALL} SELECT prot_id, 'prot' || lpad(CAST(prot_id AS VARCHAR), 9, '0') AS name, row_number() OVER (ORDER BY 'prot' || lpad(CAST(prot_id AS VARCHAR), 9, '0')) - 1 AS subject FROM (SELECT DISTINCT prot_id FROM seeds)",
    "query_skip": _ALL.replace("WITH", "WITH RECURSIVE", 1) + _WALK,
    "seed_merge": f"{_ALL}, {_MERGED} SELECT * FROM merged",
    "dominance_seeds": f"{_ALL}, {_MERGED}{_DOMINANCE}",
    "planted_adaptive_seeds": _ADAPTIVE,
    "planted_ungapped": _UNGAPPED,
    "planted_chains": _CHAINS,
    "seed_evalues": f"""{_PLANTED}, {_SEEDS}, {_MERGED}, t AS (SELECT CAST(sum(length(aa)) AS DOUBLE) AS letters FROM prot),
s AS (SELECT m.*, {MATCH} * (r_stop - r_start) AS score, length(dna) AS read_len, length(aa) AS ref_len, letters FROM merged m JOIN reads USING (doc_id) JOIN prot USING (prot_id), t)
SELECT doc_id, prot_id, strand, q_start, round((0.267 * score - ln(0.041)) / ln(2), 6) AS bits, round(log10(0.041 * letters * read_len * exp(-0.267 * score)), 6) AS log_evalue,
       round(log10(0.041 * 1e9 * 1e9 * exp(-0.267 * score)), 6) AS log_evalue_fixed, CAST(floor(CAST(r_stop - r_start AS DOUBLE) / ref_len * 100) AS BIGINT) AS coverage FROM s""",
    "planted_skip": f"{_PLANTED}, {_SEEDS}{_WALK}",
    "planted_merge": f"{_PLANTED}, {_SEEDS}, {_MERGED} SELECT * FROM merged",
    "planted_dominance": f"{_PLANTED}, {_SEEDS}, {_MERGED}{_DOMINANCE}",
    "optimal_extensions": f"""{_ALL}, t AS (SELECT s.*, pep.aa, prot.aa AS r_aa, least({AROUND}, q_pos, r_pos) AS l FROM seeds s JOIN pep USING (doc_id, frame) JOIN prot USING (prot_id)),
p AS (SELECT *, l + {K} + least({AROUND}, length(aa) - q_pos - {K}, length(r_aa) - r_pos - {K}) AS n FROM t),
x AS (SELECT *, list_transform(range(1, n + 1), lambda k: CASE WHEN aa[q_pos - l + k] = r_aa[r_pos - l + k] AND aa[q_pos - l + k] NOT IN ('X', '*') THEN {MATCH} ELSE {MISMATCH} END) AS steps FROM p),
y AS (SELECT *, list_transform(range(1, n + 1), lambda k: list_sum(steps[1:k])) AS sums FROM x)
SELECT doc_id, frame, prot_id, q_pos, r_pos, CAST(list_sum(steps) AS BIGINT) AS total,
       len(list_filter(range(1, n + 1), lambda k: sums[k] <= 0 OR sums[k] < coalesce(list_max(sums[1:k - 1]), 0) - {DROP})) = 0 AND sums[n] > 0 AND (n = 1 OR sums[n] >= list_max(sums)) AS optimal FROM y""",
    "dedupe_reads": "SELECT source || '-' || length(text) AS id, min(doc_id) AS rank FROM documents GROUP BY 1",
    "run_counters": f"WITH {_READS}, {_PROT} SELECT * FROM (SELECT count(*) AS n_reads, CAST(sum(length(dna)) AS BIGINT) AS n_bases FROM reads), (SELECT count(*) AS n_proteins, CAST(sum(length(aa)) AS BIGINT) AS n_letters FROM prot)",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            revcomp, translate_frame1, six_frame, pack_dna, reduce_alphabet, seq_stats, ka_lookup, min_seed_score, prefix_histogram, suffixes, lcp_neighbours, minimizers,
            seed_join_k, adaptive_seed_join, ungapped_xdrop, diagonal_suppress, diagonal_window_best, strand_choice, linear_chain, frameshift_blastx, gapped_blastx,
            alignment_stats, blast_tab, blast_tab_extended, dominance_filter, subject_ids, dedupe_reads, run_counters,
            query_skip, seed_merge, dominance_seeds, optimal_extensions,
            planted_adaptive_seeds, planted_ungapped, planted_chains, seed_evalues, planted_skip, planted_merge, planted_dominance,
        )
    }
