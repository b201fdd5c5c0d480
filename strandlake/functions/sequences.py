"""Column expressions over nucleotide and protein strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: Fixed value: the standard code in the order T, C, A, G of each place; stop codons read X.
CODE = "FFLLSSSSYYXXCCXWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
BASES = "TCAG"
AMINO_ACIDS = "ARNDCQEGHILKMFPSTWYVBJZX*"
CODONS = {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}


def normal_dna(seq: Column) -> Column:
    """Upper case, U as T, and any other letter as A (as a two-bit code reads it)."""
    return F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^ACGT]", "A")


def reverse_complement(dna: Column) -> Column:
    return F.translate(F.reverse(dna), "ACGT", "TGCA")


def translate(dna: str, frame: int) -> Column:
    """Amino acids of the column ``dna`` from base ``frame`` (1 to 3) on; a partial codon is left out.

    Each codon gets a mark behind it, then the 64 marked codons are replaced one after the other:
    plain scans of bytes, as a lookup per codon is far slower.  What is left is unknown.
    """
    marked = f"regexp_replace(regexp_replace(substr({dna}, {frame}), '(...)', '$1,'), '[^,]{{1,2}}$', '')"
    for codon, a in CODONS.items():
        marked = f"replace({marked}, '{codon},', '{a}')"
    return F.expr(f"regexp_replace({marked}, '...,', 'X')")


def six_frames(reads: DataFrame, dna: str = "dna", keep: bool = True) -> DataFrame:
    """Each read once per frame 1, 2, 3, -1, -2, -3, with its peptide ``aa``; a null read has null peptides.

    An Arrow batch of reads at a time: codons are numbers there, looked up all at once.  Without ``keep`` the
    bases, three times the letters of all six peptides, stay behind.
    """
    at = reads.columns.index(dna)
    others = [k for k in range(len(reads.columns)) if keep or k != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            aa = [None if x is None else p for x in batch.column(at).to_pylist() for p in (peptides(x) if x is not None else [None] * 6)]
            rows = np.repeat(np.arange(batch.num_rows), 6)
            frames = pa.array(np.tile(np.array(FRAMES, np.int32), batch.num_rows))
            columns = [batch.column(k).take(pa.array(rows)) for k in others]
            yield pa.RecordBatch.from_arrays([*columns, frames, pa.array(aa, pa.string())], names=[*(batch.schema.names[k] for k in others), "frame", "aa"])

    schema = StructType([*(reads.schema.fields[k] for k in others), StructField("frame", IntegerType()), StructField("aa", StringType())])
    return reads.mapInArrow(run, schema)


FRAMES = (1, 2, 3, -1, -2, -3)
CODE_OF = np.full(256, 64, np.uint8)
CODE_OF[[ord(c) for c in BASES]] = np.arange(4)
#: The complement of a base's number; others stay others.
OTHER_STRAND = np.array([2, 3, 0, 1], np.uint8)
AMINO = np.frombuffer(CODE.encode(), np.uint8)


def peptides(dna: str) -> list[str]:
    """The six peptides of a read, in the order of FRAMES."""
    plus = CODE_OF[np.frombuffer(dna.encode("utf-8", "replace"), np.uint8)]
    minus = plus[::-1].copy()
    minus[minus < 4] = OTHER_STRAND[minus[minus < 4]]
    out = []
    for strand in (plus, minus):
        b = strand.astype(np.uint16)
        code = b[:-2] * 16 + b[1:-1] * 4 + b[2:] if len(b) > 2 else b[:0]
        letters = np.where((b[:-2] < 4) & (b[1:-1] < 4) & (b[2:] < 4), AMINO[np.minimum(code, 63)], ord("X")).astype(np.uint8) if len(b) > 2 else b[:0].astype(np.uint8)
        out += [letters[f::3].tobytes().decode() for f in range(3)]
    return out


def reduced(aa: Column, groups: dict[str, str] | None = None) -> Column:
    """Amino acids by the first letter of their group; no groups leave them as they are."""
    if not groups:
        return aa
    return F.translate(aa, "".join(groups), "".join(groups.values()))


def frame_of(q_start: Column, read_length: Column, plus: Column) -> Column:
    """Frame from a start in the read and the strand."""
    return F.when(plus, q_start % 3 + 1).otherwise(-((read_length - 1 - q_start) % 3) - 1).cast("int")


def common_prefix(a: str, b: str, longest: int) -> Column:
    """Length of the common prefix of two string columns, at most ``longest``; 0 for null."""
    # equal prefixes are equal in all shorter ones: lengths are added from large to small powers of two
    steps = ", ".join(str(1 << k) for k in reversed(range(longest.bit_length())))
    fits = f"n + s <= least(length({a}), length({b}), {longest}) AND substr({a}, 1, n + s) = substr({b}, 1, n + s)"
    same = f"aggregate(array({steps}), 0, (n, s) -> CASE WHEN {fits} THEN n + s ELSE n END)"
    return F.expr(f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0 ELSE {same} END")


#: Five bits for each letter: A to Z, * and all others.
LETTER_BITS = np.full(256, 28, np.int64)
LETTER_BITS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ*"]] = np.arange(1, 28)


def text_pieces(batch: pa.RecordBatch, at: int, k: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, bytes]]]]:
    """``batch`` with (row, begin, letters) of some of its texts, about KMER_LETTERS at a time: all ``k``-mers lie in one of them."""
    some, letters = [], 0
    for row, x in enumerate(batch.column(at)):
        text = b"" if x.as_py() is None else x.as_buffer().to_pybytes()
        for begin in range(0, len(text) - k + 1, KMER_LETTERS):
            part = text[begin : begin + KMER_LETTERS + k - 1]
            some.append((row, begin, part))
            letters += len(part)
            if letters >= KMER_LETTERS:
                yield batch, some
                some, letters = [], 0
    if some:
        yield batch, some


#: Letters whose k-mers are made at once.
KMER_LETTERS = 1 << 18


def kmers(rows: DataFrame, seq: str, k: int, keep: list[str], wanted: Broadcast | None = None) -> DataFrame:
    """(keep, pos, kmer) of every position; a k-mer of up to 12 letters is a long, five bits a letter.  Texts are taken
    up to KMER_LETTERS at once, and longer ones in pieces of as many, so a task's arrays stay the same on any input.

    ``wanted``, a broadcast sorted array of k-mers, leaves only these: of many peptides against few
    proteins, hardly any leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value if wanted is not None else None
        for batch, some in (x for b in batches for x in text_pieces(b, len(keep), k)):
            codes, places, owners = [], [], []
            for n, begin, text in some:
                bits = LETTER_BITS[np.frombuffer(text, np.uint8)]
                code = np.zeros(len(bits) - k + 1, np.int64)
                for j in range(k):
                    code <<= 5
                    code |= bits[j : j + len(code)]
                place = np.arange(len(code))
                if known is not None:
                    near = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
                    place = place[known[near] == code] if len(known) else place[:0]
                codes.append(code[place]), places.append(begin + place), owners.append(np.full(len(place), n))
            owner = pa.array(np.concatenate([*owners, np.empty(0, np.int64)]).astype(np.int64))
            columns = [batch.column(c).take(owner) for c in range(len(keep))]
            place = np.concatenate([*places, np.empty(0, np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place), pa.array(np.concatenate([*codes, np.empty(0, np.int64)]).astype(np.int64))], names=[*keep, "pos", "kmer"])

    kept = rows.select(*keep, F.col(seq).alias("_seq"))
    schema = StructType([*kept.schema.fields[:-1], StructField("pos", IntegerType()), StructField("kmer", LongType())])
    return kept.mapInArrow(run, schema)
