"""Token counts of documents by a separator scan of flat token files.

:func:`write_files` tokenises documents into flat files of big-endian 16-bit ids, each
document followed by the end-of-document id, without any index.  The writer is Spark's text
writer: a row's bytes are its ids, the line separator is the end id.  The doc_ids stand in
the same order in files of their own, without places or lengths.  :func:`scan` reads
such files as blocks, searches each block for the end id at once, and joins the blocks by
a prefix scan: the last end before a block gives the length of the document that reaches
into it.  Files hold about ``shard_chars`` characters, so a task's memory is bounded.

Defined results: null and empty texts have no tokens and a count of 0; repeated rows are
counted each; ids after the last end id of a file belong to no document; an empty file or
table gives no rows; rows alike in doc_id and text tie, and have the same count; a text of any
length is read whole, by the one task that encodes it, and may reach over many blocks of a
file; further columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir

#: An id above the vocabulary of 50,256 whose two bytes are one UTF-8 character.
END_ID = 0xC480
BLOCK = 1 << 16
_ENCODERS: dict = {}


def encoder(path: str):
    """The byte-level tokenizer of a rank file, kept by the worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def write_files(docs: DataFrame, path: str, tokenizer: str, shard_chars: int) -> None:
    """Flat token files under ``path``/kind=tokens, and the doc_ids in the same order, in
    files of the same names, under ``path``/kind=names.

    Each task writes the files of its own rows, both kinds at once: nothing is shuffled and
    a repeated task repeats both.  A task starts another file every ``shard_chars`` characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        place = shard = chars = 0
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                out.append(("names", shard, place, b"" if doc_id is None else str(doc_id).encode()))
                out.append(("tokens", shard, place, np.array(encode(text), ">u2").tobytes()))
                place, chars = place + 1, chars + len(text)
                if chars >= shard_chars:
                    shard, chars = shard + 1, 0
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["kind", "shard", "place", "value"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "kind string, shard int, place long, value binary")
    rows = rows.sortWithinPartitions("kind", "shard", "place").select("kind", "shard", F.col("value").cast("string").alias("value"))
    rows.write.partitionBy("kind", "shard").option("lineSep", END_ID.to_bytes(2, "big").decode()).text(path)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(shard, content): the files under ``path``, named by the writing task and its file's number."""
    name = F.concat_ws("-", F.regexp_extract("path", r"part-(\d+)", 1), F.regexp_extract("path", r"shard=(\d+)", 1))
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select(name.alias("shard"), "content")


def names_of(spark: SparkSession, path: str) -> DataFrame:
    """(shard, ordinal, doc_id) of the files of doc_ids under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = [int(x) if x else None for x in content.as_py().split(END_ID.to_bytes(2, "big"))[:-1]]
                columns = [pa.array([shard] * len(ids), pa.string()), pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "ordinal", "doc_id"])

    return files_of(spark, path).mapInArrow(run, "shard string, ordinal long, doc_id long")


def scan(spark: SparkSession, path: str, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """(shard, ordinal, start, n_tokens) of each document of the token files under ``path``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, content in zip(frame["shard"], frame["content"], strict=True):
                ids = np.frombuffer(content, ">u2")
                rows = []
                for k in range(0, len(ids), block):
                    ends = np.flatnonzero(ids[k : k + block] == end_id) + k
                    rows.append((shard, k // block, ends))
                yield pd.DataFrame(rows, columns=["shard", "block", "ends"])

    blocks = files_of(spark, path).mapInPandas(run, "shard string, block long, ends array<long>")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = blocks.withColumns(
        {
            "last": F.coalesce(F.max(F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1)).over(before), F.lit(-1)),
            "seen": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)),
        }
    )
    each = stitched.select("shard", "seen", F.expr("concat(array(last), ends)").alias("ends"), F.posexplode("ends").alias("k", "end"))
    start = F.expr("ends[k] + 1")
    return each.select("shard", (F.col("seen") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, shard_chars: int = 4_000_000) -> DataFrame:
    """One row per document: doc_id, shard, start (in ids) and n_tokens, through token files."""
    spark = docs.sparkSession
    if docs.limit(1).count() == 0:
        return spark.createDataFrame([], "doc_id long, shard string, start long, n_tokens long")
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_files(docs, path, tokenizer, shard_chars)
    found = names_of(spark, f"{path}/kind=names").join(scan(spark, f"{path}/kind=tokens"), ["shard", "ordinal"])
    return found.select("doc_id", "shard", "start", "n_tokens")
