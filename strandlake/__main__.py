"""Command line: ``python -m strandlake makedb|blastx|convert|merge``; ``spark-submit`` takes the same arguments."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.config import SearchConfig
from strandlake.functions.statistics import KARLIN_ALTSCHUL, known_rows
from strandlake.plans import search
from strandlake.sources import daa, fasta, fastq, results

FORMATS = ("daa", "tab", "tab22", "pairwise", "xml")


def positive(kind: type, least: float = 0) -> callable:
    def read(text: str) -> float:
        value = kind(text)
        if value < least:
            raise argparse.ArgumentTypeError(f"{text} is less than {least}")
        return value

    return read


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandlake", description="Translated protein search on Spark")
    mode = top.add_subparsers(dest="mode", required=True)
    db = mode.add_parser("makedb", help="index a protein FASTA file")
    db.add_argument("-i", "--input", required=True)
    db.add_argument("-d", "--db", required=True)
    db.add_argument("--minimizers", type=positive(int, 1), nargs=2, metavar=("P", "Q"), help="index only the smallest of P letters in each window of Q")
    run = mode.add_parser("blastx", help="align DNA reads with an index")
    run.add_argument("-i", "--input", required=True, help="FASTA or FASTQ (.fq, .fastq), plain or gz")
    run.add_argument("-d", "--db", required=True)
    run.add_argument("-o", "--output", required=True)
    run.add_argument("--format", choices=FORMATS, default="daa")
    run.add_argument("-m", "--multiplicity", type=positive(int, 1), default=10)
    run.add_argument("-e", "--evalue", type=positive(float), default=1e-3)
    run.add_argument("-c", "--coverage", type=positive(int), default=0)
    run.add_argument("-F", "--frameshift", type=positive(int), default=15, help="penalty; 0 for none")
    run.add_argument("--matrix", default="BLOSUM80", help="name of the matrix, for its statistics")
    run.add_argument("--statistics", help="file of rows: matrix, gap opening, gap extension, lambda, K, H; for other matrices than the built-in ones")
    run.add_argument("--walk", action="store_true", help="skip a hit's matched letters, position by position")
    run.add_argument("--matrix-path", help="file of the matrix in the NCBI text format; without it letters match or not")
    run.add_argument("--gop", type=int, help="gap opening; the first known one of the matrix by default")
    run.add_argument("--gep", type=int, help="gap extension")
    run.add_argument("--dominance", action="store_true", help="leave dominated alignments out")
    to = mode.add_parser("convert", help="turn an archive into text")
    to.add_argument("-i", "--input", required=True)
    to.add_argument("-o", "--output", required=True)
    to.add_argument("--format", choices=FORMATS[1:], default="tab")
    both = mode.add_parser("merge", help="merge archives of the same reads")
    both.add_argument("-i", "--input", required=True, nargs="+")
    both.add_argument("-o", "--output", required=True)
    both.add_argument("--dominance", action="store_true")
    out = mode.add_parser("dump", help="write the proteins of an index as FASTA")
    out.add_argument("-d", "--db", required=True)
    out.add_argument("-o", "--output", required=True)
    return top


def config_of(args: argparse.Namespace, rows: list[tuple] = KARLIN_ALTSCHUL) -> SearchConfig:
    """The search's parameters; a matrix or penalties that ``rows`` have no statistics for are an error."""
    known = [(o, e) for m, o, e, *_ in rows if m == args.matrix]
    if not known:
        raise SystemExit(f"no statistics for {args.matrix}, only for {', '.join(sorted({m for m, *_ in rows}))}")
    penalties = (args.gop if args.gop is not None else known[0][0], args.gep if args.gep is not None else known[0][1])
    if penalties not in known:
        raise SystemExit(f"{args.matrix} takes gap penalties {', '.join(f'{o}/{e}' for o, e in known)}, not {penalties[0]}/{penalties[1]}")
    return SearchConfig(
        matrix=args.matrix, matrix_path=args.matrix_path, statistics_path=args.statistics, query_skip=args.walk, gap_open=penalties[0], gap_extend=penalties[1], frameshift=args.frameshift or None,
        multiplicity=args.multiplicity, max_evalue=args.evalue, min_coverage=args.coverage, dominance=args.dominance,
    )


def write(found: DataFrame, path: str, form: str) -> None:
    if form == "tab":
        results.write_tab(results.blast_tab(found), path)
    elif form == "tab22":
        results.write_tab(results.blast_tab_extended(found), path)
    elif form == "pairwise":
        results.write_pairwise(found, path)
    else:
        results.write_blast_xml(found, path)


def blastx(spark: SparkSession, args: argparse.Namespace) -> None:
    config = config_of(args, known_rows(spark, args.statistics))
    proteins, suffixes = search.read_db(spark, args.db)
    qualities = args.input.removesuffix(".gz").endswith((".fq", ".fastq"))
    rows = fastq.read_fastq(spark, args.input) if qualities else fasta.read_fasta(spark, args.input)
    reads = search.reads_of(rows)
    found = search.named(search.blastx(reads, proteins, config, suffixes), reads, proteins)
    if args.format != "daa":
        return write(found, args.output, args.format)
    size = proteins.agg(F.count("*"), F.coalesce(F.sum(F.length("aa")), F.lit(0))).first()
    _, lam, k = search.scoring(spark, config)
    daa.write_daa(found, args.output, size[0], size[1], config, lam, k)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("strandlake").getOrCreate()
    if args.mode == "makedb":
        search.make_db(spark, args.input, args.db, args.minimizers and tuple(args.minimizers))
    elif args.mode == "blastx":
        blastx(spark, args)
    elif args.mode == "dump":
        fasta.write_fasta(search.read_db(spark, args.db)[0], args.output, seq="aa")
    elif args.mode == "convert":
        write(search.archived(spark, args.input), args.output, args.format)
    else:
        search.merge_archives(spark, args.input, args.output, SearchConfig(dominance=args.dominance))


if __name__ == "__main__":
    main()
