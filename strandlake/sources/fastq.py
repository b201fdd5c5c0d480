"""FASTQ files whose sequences and qualities may go over several lines, read from splits.

Quality lines may start with @ like records do, so where a record starts depends on all before it.
Files are read in fragments, each from one line that starts with @ to the next.  Between fragments the
state is one number, the quality letters that the record so far still lacks: at 0 a fragment is a
record of its own, else it goes on with the last one.  A split's effect on that number is a small
table (:func:`effect`): what it makes of 0, and of the few numbers that end a record at
one of its first fragments.  These tables are composed in the order of the splits, a row each,
and then every split knows with which state it starts.  Only records that lie over the bounds of
splits are put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A state from which no record can be read.
BROKEN = -1
#: Marks the row of a split that holds its letters: a state of as many or more only gets smaller in it.
WHOLE = -2
#: Letters of an open record up to which a split's table is made: the longest sequence of the split (0), then
#: more, if a record that comes from an earlier split turns out to be longer.
LONGEST = (0, 1 << 16, 1 << 62)
PIECES = "file string, start_block long, start_n long, rank long, part long, text string"
FOUND = "file string, rank long, id string, seq string, quality string"


def letters(text: str) -> tuple[int, int, int]:
    """(as a record of its own, the quality letters that are missing, BROKEN if it has no + line or too many of
    them; as the rest of one, its letters with the mark that was cut off; the letters of its sequence)."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    plus = next((k for k, x in enumerate(lines) if k and x.startswith("+")), 0)
    bases = sum(map(len, lines[1:plus]))
    lack = bases - sum(map(len, lines[plus + 1 :])) if plus else BROKEN
    return max(lack, BROKEN), sum(map(len, lines)) + 1, bases


def effect(lack: np.ndarray, size: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(state, end, records): the states up to ``longest`` at the start of a split from which its fragments can be
    read, with the state at its end and how many records start in it; last, as state WHOLE, all its letters."""
    n = len(lack)
    upto = np.concatenate(([0], np.cumsum(size)))
    end, count = np.full(n + 1, BROKEN, np.int64), np.zeros(n + 1, np.int64)
    end[n] = 0
    # where a record that starts at a fragment ends: after as many letters as it lacks
    for k in range(n - 1, -1, -1):
        if lack[k] < 0:
            continue
        stop = upto[k + 1] + lack[k]
        at = int(np.searchsorted(upto, stop))
        if stop > upto[n]:
            end[k], count[k] = stop - upto[n], 1
        elif upto[at] == stop:
            end[k], count[k] = end[at], count[at] + 1
    good = np.flatnonzero((end >= 0) & (upto <= longest))
    return [(int(upto[k]), int(end[k]), int(count[k])) for k in good] + [(WHOLE, int(upto[n]), 0)]


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, text): what lies between marks, in the order ``n`` within each split."""
    rows = spark.read.option("lineSep", "\n@").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("text"))


def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Table]]:
    """The fragments of one split after the other."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        blocks = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        begin = 0
        for k in range(1, len(blocks) + 1):
            if k == len(blocks) or blocks[k] != blocks[begin]:
                if held and key != blocks[begin]:
                    yield *key, pa.Table.from_batches(held)
                    held = []
                key = blocks[begin]
                held.append(batch.slice(begin, k - begin))
                begin = k
    if held:
        yield *key, pa.Table.from_batches(held)


def measured(table: pa.Table, first: bool) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    texts = table.column(3).to_pylist()
    if first and texts:
        texts[0] = texts[0].lstrip("\n\r\t ").removeprefix("@")  # the file's first mark follows no line end
    return texts, *np.array([letters(t) for t in texts], np.int64).reshape(-1, 3).T


def starts(found: DataFrame, longest: int) -> pd.DataFrame | None:
    """(file, block, state, rank): the state at the start of each split and the number of its first record, from
    a few rows a split; None if a record is longer than the tables reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, table in splits(batches):
            _, lack, size, bases = measured(table, block == 0)
            rows = effect(lack, size, longest or int(bases.max(initial=0)))
            columns = [[file] * len(rows), [block] * len(rows), *(list(x) for x in zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["file", "block", "state", "end", "records"])

    tables = found.mapInArrow(run, "file string, block long, state long, end long, records long").toPandas()
    out = []
    for file, blocks in tables.groupby("file"):
        state, rank = 0, 0
        for block, rows in blocks.groupby("block"):
            out.append((file, int(block), state, rank))
            known = {int(s): (int(e), int(r)) for s, e, r in zip(rows["state"], rows["end"], rows["records"], strict=True)}
            whole = known.pop(WHOLE)[0]
            if state not in known and state < whole:
                return None
            state, more = known[state] if state in known else (state - whole, 0)
            rank += more
        if state:
            raise ValueError(f"{file} ends within a record")
    return pd.DataFrame(out, columns=["file", "block", "state", "rank"])


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, rank, id, seq, quality): ``rank`` numbers a file's records, sequences are in upper case."""
    found = fragments(spark, path)
    known = next((x for x in (starts(found, n) for n in LONGEST) if x is not None), None)
    if known is None:
        raise ValueError(f"{path} holds a record whose quality is not as long as its sequence")
    sent = spark.sparkContext.broadcast({(f, b): (s, r) for f, b, s, r in known.itertuples(index=False)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, table in splits(batches):
            texts, lack, size, _ = measured(table, block == 0)
            state, rank = sent.value[file, block]
            rows = []
            for text, missing, n in zip(texts, lack.tolist(), size.tolist(), strict=True):
                if state:
                    rows.append((rank - 1, block, "@" + text))
                    state -= n
                else:
                    rows.append((rank, block, text))
                    state, rank = missing, rank + 1
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (1, pa.int64()))), pa.array(range(len(rows)), pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["file", "rank", "block", "place", "text"])

    return records(found.mapInArrow(run, "file string, rank long, block long, place long, text string"), known)


def records(pieces: DataFrame, known: pd.DataFrame) -> DataFrame:
    """Records from their pieces: those that lie in one split are put together there."""
    spark = pieces.sparkSession
    # records that are open at the start of a split, a row for each split at most
    over = known[known["state"] > 0][["file", "rank"]].drop_duplicates()
    open_ranks = {(f, int(r) - 1) for f, r in over.itertuples(index=False)}
    sent = spark.sparkContext.broadcast(open_ranks)

    def parsed(file: str, rank: int, text: str) -> tuple:
        lines = [x.rstrip("\r") for x in text.split("\n")]
        plus = next(k for k, x in enumerate(lines) if k and x.startswith("+"))
        head = lines[0].split()
        return file, rank, head[0] if head else "", "".join(lines[1:plus]).upper(), "".join(lines[plus + 1 :])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in FOUND.split(", ")])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            rows = []
            for file, rank, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4)), strict=True):
                if (file, rank) in sent.value:
                    continue
                if held and held[:2] == (file, rank):
                    held = (file, rank, held[2] + "\n" + text)
                    continue
                if held:
                    rows.append(parsed(*held))
                held = (file, rank, text)
            yield batch_of(rows)
        if held:
            yield batch_of([parsed(*held)])

    out = pieces.mapInArrow(within, FOUND)
    if not open_ranks:
        return out

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([x in sent.value for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.bool_()))

    def joined(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("block", "ascending"), ("place", "ascending")])
        return pa.Table.from_batches([batch_of([parsed(rows.column("file")[0].as_py(), rows.column("rank")[0].as_py(), "\n".join(rows.column("text").to_pylist()))])])

    return out.union(pieces.mapInArrow(across, pieces.schema).groupBy("file", "rank").applyInArrow(joined, FOUND))
