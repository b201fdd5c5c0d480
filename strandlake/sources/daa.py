"""Binary alignment archives (DAA): a header, a record per read with its alignments, subject names and lengths.

An archive is written as volumes.  All alignments of a read lie in one volume, a volume is made
by one task from about ``volume_rows`` alignments and holds the names of its own subjects, so a
result of any size is written in parallel, through Spark's own writer; the line end behind the last block
is not part of the format and is not read.  Reading takes ranges of records (:func:`read_daa`), so a volume
of any size, also one of another program, is decoded by many tasks.

Null names are written as empty ones, reads without alignments are not written, equal rows are
written each; an empty table gives a folder without volumes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.config import SearchConfig
from strandlake.functions.sequences import CODE_OF, CODONS
from strandlake.operators.alignment import score_table
from strandlake.tables import stored

#: Layout of the header (longs, integers, doubles, matrix name, block sizes, block types),
#: its first number, and the letters of edit operations.
HEADER = struct.Struct("<8q8i4d16s256q256b")
MAGIC = 4327487858190246763
LETTERS = "ARNDCQEGHILKMFPSTWYVBJZX*/\\"
LETTER = {c: k for k, c in enumerate(LETTERS)}
#: Kinds of edit operations: equal pairs, codons without an amino acid, an amino acid alone, another pair or a frame shift.
MATCH, INSERT, DELETE, OTHER = 0, 1, 2, 3
#: Numbers of TCAG in order of ACGT, which the format uses.
ACGT_OF = np.array([3, 1, 0, 2], np.uint8)
END = "\n"


def packed_bases(dna: str) -> bytes:
    """Two bits a base (A, C, G, T; any other is A), from the low bits of each byte on."""
    code = CODE_OF[np.frombuffer(dna.encode("ascii", "replace"), np.uint8)]
    bits = np.where(code < 4, ACGT_OF[np.minimum(code, 3)], 0).astype(np.uint8)
    four = np.zeros((-(-len(bits) // 4), 4), np.uint8)
    four.reshape(-1)[: len(bits)] = bits
    return (four << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8).tobytes()


def unpacked_bases(data: bytes, length: int, bits: int = 2) -> str:
    """The bases of packed bytes; of three bits a base, 4 and more are N."""
    each = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: length * bits].reshape(length, bits)
    code = (each << np.arange(bits, dtype=np.uint8)).sum(axis=1)
    return np.frombuffer(b"ACGTNNNN", np.uint8)[code].tobytes().decode()


def edit_bytes(query_line: str, subject_line: str) -> bytes:
    """The edit script of an alignment's lines; runs are cut after 63, shifts stand by themselves."""
    out, run, kind = bytearray(), 0, MATCH

    def flush() -> None:
        nonlocal run
        while run:
            n = min(run, 63)
            out.append(kind << 6 | n)
            run -= n

    for q, r in zip(query_line, subject_line, strict=True):
        now = OTHER if q in "/\\" else INSERT if r == "-" else DELETE if q == "-" else MATCH if q == r else OTHER
        if now in (MATCH, INSERT):
            if now != kind:
                flush()
                kind = now
            run += 1
        else:
            flush()
            out.append(now << 6 | LETTER.get(q if q in "/\\" else r, LETTER["*"]))
    flush()
    return bytes(out)


def edit_lines(script: bytes, strand: str, start: int, table: np.ndarray) -> tuple[str, str, str, str, int, int]:
    """(ops, query, middle, subject line, bases, amino acids) of an edit script that starts at base ``start`` of ``strand``."""
    ops, q, mid, r, j, n = [], [], [], [], start, 0
    for op in script:
        kind, value = op >> 6, op & 63
        if kind == OTHER and LETTERS[value] in "/\\":
            ops.append(LETTERS[value]), q.append(LETTERS[value]), mid.append(" "), r.append("-")
            j += 1 if LETTERS[value] == "\\" else -1
        elif kind == DELETE:
            ops.append("D"), q.append("-"), mid.append(" "), r.append(LETTERS[value])
            n += 1
        else:
            for _ in range(value if kind in (MATCH, INSERT) else 1):
                a = CODONS.get(strand[j : j + 3], "X")
                b = a if kind == MATCH else "-" if kind == INSERT else LETTERS[value]
                ops.append("I" if kind == INSERT else "M"), q.append(a), r.append(b)
                mid.append(a if a == b else "+" if b != "-" and table[ord(a), ord(b)] > 0 else " ")
                j, n = j + 3, n + (kind != INSERT)
    return "".join(ops), "".join(q), "".join(mid), "".join(r), j - start, n


def packed_number(data: bytes, at: int, kind: int) -> tuple[int, int]:
    """An unsigned number of 1, 2 or 4 bytes, by its kind, and where the next value starts."""
    if kind > 2:
        raise ValueError(f"no number is of kind {kind}")
    size = 1 << kind
    return int.from_bytes(data[at : at + size], "little"), at + size


def turned(dna: str) -> str:
    return dna[::-1].translate(str.maketrans("ACGT", "TGCA"))


def volume(rows: pd.DataFrame, head: tuple, matrix: str) -> bytes:
    """The bytes of an archive of alignments (read_name, dna, subject, strand, score, q_start, r_start, ref_len, lines)."""
    subjects: dict[str, tuple[int, int]] = {}
    body = bytearray()
    sequences, letters, gap_open, gap_extend, shift, k, lam = head
    reads = 0
    for (name, dna), hits in rows.groupby(["read_name", "dna"], sort=False):
        record = bytearray(struct.pack("<i", len(dna)) + name.encode() + b"\0\0" + packed_bases(dna))
        for h in hits.itertuples(index=False):
            number, _ = subjects.setdefault(h.subject, (len(subjects), int(h.ref_len)))
            start = h.q_start if h.strand == "+" else len(dna) - h.q_start - 1
            record += struct.pack("<iBIII", number, 2 | 2 << 2 | 2 << 4 | (h.strand != "+") << 6, h.score, start, h.r_start)
            record += edit_bytes(h.query_line, h.subject_line) + b"\0"
        body += struct.pack("<i", len(record)) + record
        reads += 1
    body += struct.pack("<i", 0)
    names = b"".join(n.encode() + b"\0" for n in subjects)
    lengths = b"".join(struct.pack("<i", n) for _, n in subjects.values())
    sizes, kinds = [len(body), len(names), len(lengths)], [1, 2, 3]
    header = HEADER.pack(
        MAGIC, 0, 0, sequences, len(subjects), letters, 0, reads, 3, gap_open, gap_extend, 0, shift or 0, 0, 0, 0, k, lam, 0.0, 0.0,
        matrix.encode()[:16], *sizes, *[0] * 253, *kinds, *[0] * 253,
    )
    return header + bytes(body) + names + lengths


def header_of(data: bytes) -> dict:
    """The header's values and where its blocks start: a dict with sizes by block type."""
    v = HEADER.unpack_from(data)
    if v[0] != MAGIC:
        raise ValueError("no alignment archive")
    sizes, kinds = v[21 : 21 + 256], v[277:]
    blocks, at = {}, HEADER.size
    for size, kind in zip(sizes, kinds, strict=True):
        if kind:
            blocks[kind] = (at, size)
            at += size
    return {
        "db_seqs": v[3], "db_seqs_used": v[4], "db_letters": v[5], "reads": v[7], "gap_open": v[9], "gap_extend": v[10], "shift": v[12] or None,
        "k": v[16], "lambda": v[17], "matrix": v[20].rstrip(b"\0").decode(), "blocks": blocks,
    }


def reads_in(body: bytes, wanted: set[str] | None = None) -> Iterator[tuple[str, int, int, int, int]]:
    """(name, bits a base, bases, start and end of the rest) of each read whose record is in ``body``, or of those ``wanted``."""
    at = 0
    while at < len(body):
        size, length = struct.unpack_from("<ii", body, at)
        name_end = body.index(b"\0", at + 8)
        name = body[at + 8 : name_end].decode()
        if wanted is None or name in wanted:
            yield name, 3 if body[name_end + 1] & 1 else 2, length, name_end + 2, at + 4 + size
        at += 4 + size


def hits_in(body: bytes, at: int, stop: int) -> Iterator[tuple[int, bool, int, int, int, bytes]]:
    """(subject, whether on the plus strand, score, start, start in the subject, edit script) of a read's alignments."""
    while at < stop:
        subject, flag = struct.unpack_from("<iB", body, at)
        score, at = packed_number(body, at + 5, flag & 3)
        start, at = packed_number(body, at, flag >> 2 & 3)
        r_start, at = packed_number(body, at, flag >> 4 & 3)
        end = body.index(b"\0", at)
        yield subject, not flag & 64, score, start, r_start, body[at:end]
        at = end + 1


def subjects_in(body: bytes, wanted: set[str] | None = None) -> set[int]:
    return {hit[0] for _, bits, length, at, stop in reads_in(body, wanted) for hit in hits_in(body, at + (length * bits + 7) // 8, stop)}


def alignments_in(body: bytes, names: dict[int, str], lengths: dict[int, int], table: np.ndarray, wanted: set[str] | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA from whole records."""
    for name, bits, length, at, stop in reads_in(body, wanted):
        width = (length * bits + 7) // 8
        dna = unpacked_bases(body[at : at + width], length, bits)
        for subject, plus, score, start, r_start, edits in hits_in(body, at + width, stop):
            start = start if plus else length - 1 - start
            ops, q, mid, r, bases, aminos = edit_lines(edits, dna if plus else turned(dna), start, table)
            yield (name, dna, names[subject], "+" if plus else "-", score, start, start + bases, r_start, r_start + aminos, length, lengths[subject], ops, q, mid, r)


SCHEMA = (
    "read_name string, dna string, subject string, strand string, score long, q_start long, q_stop long, r_start long, r_stop long, "
    "read_len long, ref_len long, ops string, query_line string, middle_line string, subject_line string"
)


def write_daa(found: DataFrame, path: str, sequences: int, letters: int, config: SearchConfig, lam: float, k: float, volume_rows: int = 200_000) -> None:
    """Alignments in the columns of SCHEMA, as volumes in the folder ``path``.

    With the reads' numbers (``doc_id``), volumes are ranges of reads, in the order of the files' names, and so are
    the records of a volume; without them, reads go to volumes by the hashes of their names.
    """
    volumes = max(1, -(-found.count() // volume_rows))
    head = (sequences, letters, config.gap_open, config.gap_extend, config.frameshift, k, lam)
    named = found.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("read_name", "subject")})
    if "doc_id" in found.columns:
        # a bound for each volume of some 200,000 rows
        bounds = sorted(set(named.approxQuantile("doc_id", [k / volumes for k in range(1, volumes)], 0.1 / volumes))) if volumes > 1 else []
        number = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b <= F.col("doc_id")))
        dealt = named.withColumns({"volume": number.cast("long"), "_order": F.col("doc_id")})
    else:
        dealt = named.withColumns({"volume": F.pmod(F.xxhash64("read_name"), F.lit(volumes)), "_order": F.lit(0).cast("long")})

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        by = ["_order", "read_name", "dna", "score", "subject", "strand", "q_start"]
        rows = rows.sort_values(by, ascending=[True, True, True, False, True, True, True])
        return pd.DataFrame({"volume": rows["volume"].iloc[:1], "value": [volume(rows, head, config.matrix)]})

    content = dealt.groupBy("volume").applyInPandas(run, "volume long, value binary")
    ordered = content.repartitionByRange(volumes, "volume").sortWithinPartitions("volume")
    ordered.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", 1).text(path)


#: Bytes of records that one task decodes at once, and of a file that are read at once.
RANGE_BYTES, CHUNK = 8 << 20, 1 << 22
#: Tasks into which the ranges of an archive are dealt at most.
MOST_TASKS = 10_000


def opened(path: str) -> pa.NativeFile:
    """A file, by the path that Spark lists, for reading at any place, from the stores that Arrow knows."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def blocks_of(file: pa.NativeFile) -> dict[int, tuple[int, int]]:
    """Places and sizes of a volume's blocks."""
    file.seek(0)
    return header_of(file.read(HEADER.size))["blocks"]


def ranges(file: pa.NativeFile, most: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of whole records, of about ``most`` bytes; only the records' lengths are looked at."""
    at, size = blocks_of(file)[1]
    end, begin = at + size - 4, at  # four zero bytes close the records
    held, place = b"", at
    while at < end:
        if not place <= at <= place + len(held) - 4:
            file.seek(at)
            held, place = file.read(CHUNK), at
        size = struct.unpack_from("<i", held, at - place)[0]
        if not size:
            break
        at += 4 + size
        if at - begin >= most:
            yield begin, at
            begin = at
    if at > begin:
        yield begin, at


def subject_names(file: pa.NativeFile, blocks: dict, numbers: set[int]) -> tuple[dict[int, str], dict[int, int]]:
    """Names and lengths of some subjects; the names of the others are passed over, a chunk at a time."""
    at, size = blocks[2]
    file.seek(at)
    found, number, rest = {}, 0, b""
    while size and len(found) < len(numbers):
        chunk = file.read(min(CHUNK, size))
        size -= len(chunk)
        *names, rest = (rest + chunk).split(b"\0")
        found |= {n: x.decode() for n, x in enumerate(names, number) if n in numbers}
        number += len(names)
    lengths = {}
    for n in sorted(numbers):
        file.seek(blocks[3][0] + 4 * n)
        lengths[n] = struct.unpack("<i", file.read(4))[0]
    return found, lengths


def read_daa(spark: SparkSession, path: str, table: np.ndarray | None = None, reads: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The alignments of all volumes under ``path``, in the columns of SCHEMA, or those of some ``reads`` (names);
    ``table`` scores similar pairs in the middle line.

    A task goes along the lengths of a volume's records and cuts them into ranges; the ranges, of all
    volumes, are dealt out, and each task reads its own bytes of the file, and the names of the
    subjects in them.  Of other reads than the wanted ones only the names are decoded.  Stores that only
    Spark can open are read a whole volume at a time.
    """
    table = score_table(None, 1, -1) if table is None else table
    wanted = None if reads is None else set(reads)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def in_batches(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        while some := list(islice(rows, 1000)):
            yield pd.DataFrame(some, columns=columns)

    def part(file: pa.NativeFile, start: int, stop: int) -> Iterator[tuple]:
        blocks = blocks_of(file)
        file.seek(start)
        body = file.read(stop - start)
        return alignments_in(body, *subject_names(file, blocks, subjects_in(body, wanted)), table, wanted)

    if not arrow_opens(spark, path):

        def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for content in (c for frame in frames for c in frame["content"]):
                file = pa.BufferReader(content)
                for start, stop in ranges(file, range_bytes):
                    yield from in_batches(part(file, start, stop))

        return volumes_of(spark, path).select("content").mapInPandas(whole, SCHEMA)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path in (p for frame in frames for p in frame["path"]):
            with opened(path) as file:
                yield pd.DataFrame([(path, *r) for r in ranges(file, range_bytes)], columns=["path", "start", "stop"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path, start, stop in (r for frame in frames for r in frame.itertuples(index=False)):
            with opened(path) as file:
                yield from in_batches(part(file, start, stop))

    found = stored(volumes_of(spark, path).select("path").mapInPandas(cut, "path string, start long, stop long"), "ranges")
    return found.repartition(max(1, min(found.count(), MOST_TASKS)), "path", "start").mapInPandas(run, SCHEMA)


def arrow_opens(spark: SparkSession, path: str) -> bool:
    """Whether Arrow can open the first of the files under ``path``."""
    first = volumes_of(spark, path).select("path").first()
    try:
        return first is None or opened(first["path"]).seekable()
    except (pa.ArrowException, OSError, ValueError):
        return False


#: What a volume's header tells.
HEADER_FIELDS = {
    "db_seqs": "long", "db_seqs_used": "long", "db_letters": "long", "reads": "long", "gap_open": "int", "gap_extend": "int", "shift": "int", "k": "double", "lambda": "double", "matrix": "string",
}


def volumes_of(spark: SparkSession, path: str) -> DataFrame:
    """The files of an archive, none of the writer's marks."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).filter("length > 0")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row per volume: path, db_seqs, db_seqs_used, db_letters, reads, penalties, statistics and matrix."""
    schema = ", ".join(f"{c} {t}" for c, t in {"path": "string", **HEADER_FIELDS}.items())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            heads = [header_of(c) for c in (frame["content"] if "content" in frame else map(first_bytes, frame["path"]))]
            yield pd.DataFrame([{"path": p, **{c: h[c] for c in h if c != "blocks"}} for p, h in zip(frame["path"], heads, strict=True)]).astype({"shift": "Int32"})

    # without the content, Spark lists the files but does not read them
    return volumes_of(spark, path).select("path", *([] if arrow_opens(spark, path) else ["content"])).mapInPandas(run, schema)


def first_bytes(path: str) -> bytes:
    with opened(path) as file:
        return file.read(HEADER.size)
