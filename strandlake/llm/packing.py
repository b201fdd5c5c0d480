"""Packing documents into training sequences by best-fit decreasing.

Tokenising is one pass of Arrow batches: a document's ids end with ``end_id``, are cut into
full windows and one rest, and each piece leaves the task as a short row (place, length and
checksum of its ids), never as text or ids.  The pieces are then dealt at random to shards of
about ``shard_pieces`` rows, so that no task grows with the input; in each shard a segment
tree over the remaining capacities finds the tightest open window for each piece, longest
first.  Only the last windows of a shard stay partly empty.

Defined results: null and empty texts are one id, ``end_id``; repeated rows are packed once
each; ties go by doc_id, start and checksum; a text of any length is cut into as many windows
as it fills; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Words remembered by a worker; beyond that it starts anew.
REMEMBERED = 1_200_000


class WordIds(dict):
    """The ids of blank-separated words, as bytes of unsigned 32-bit numbers.

    The word vocabulary drops blanks and never joins over them, so a text's ids are the
    ids of its words in order.  Plain words of Latin letters with marks behind them go
    straight to the merge table, all others through the tokenizer itself.
    """

    PLAIN = re.compile(r"([a-zßà-öø-ÿ]*)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)")
    #: Marks a word's last byte in the merge table; no UTF-8 text holds it.
    LAST = b"\xff"

    def __init__(self, path: str) -> None:
        import json

        from tiktoken import _tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.full = Tokenizer.from_file(path)
        with open(path) as f:
            model = json.load(f)
        # the printable stand-ins of the 256 bytes, as the byte-level step writes them
        letter = {ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0]: b for b in range(128)}
        for b in range(0x80, 0x800, 1):
            for c, byte in zip(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0], chr(b).encode(), strict=True):
                letter[c] = byte
        special = {x["id"] for x in model["added_tokens"]}
        ranks = {}
        for token, rank in model["model"]["vocab"].items():
            if rank not in special:
                body, end = token.removesuffix("</w>"), token.endswith("</w>")
                if all(c in letter for c in body):
                    ranks[bytes(letter[c] for c in body) + self.LAST * end] = rank
        for b in range(256):
            ranks.setdefault(bytes([b]), len(model["model"]["vocab"]) + b)
        self.merge = _tiktoken.CoreBPE(ranks, {}, ".").encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        if plain := self.PLAIN.fullmatch(word):
            ids = []
            for part in plain.groups():
                if part:
                    ids += self.merge(part.encode() + self.LAST)
        else:
            ids = self.full.encode(word, add_special_tokens=False).ids
        self[word] = out = np.array(ids, "<u4").tobytes()
        return out

    def of(self, text: str) -> bytes:
        if not is_normalized("NFC", text) or "Σ" in text or "İ" in text:
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if "<|" not in text:
            text = text.lower()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One table for each worker, kept from task to task."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def pieces(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows and a rest of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(ids_of.of(text.as_py() or "") + end)
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    out.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


class Openings:
    """Open windows by remaining capacity, under a segment tree of counts."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, number: int) -> None:
        self.open[capacity].append(number)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The window with the smallest capacity of ``least`` or more, and that capacity."""
        node = self.leaves + least
        if not self.count[node]:
            # up to the first right neighbour that holds a window, then down its left side
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece; ``lengths`` fall."""
    openings, made = Openings(window), 0
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        found = openings.take(n)
        if found is None:
            found, made = (made, window), made + 1
        number, capacity = found
        sequence[k], offset[k] = number, window - capacity
        if capacity > n:
            openings.put(capacity - n, number)
    return sequence, offset


def packed(parts: DataFrame, window: int = 4096, shard_pieces: int = 50_000) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``."""
    # numbered when they are written, so that rows alike are dealt to different shards, and the same ones at each try
    parts = stored(parts.withColumn("number", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-parts.count() // shard_pieces))
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "number"), F.lit(shards)))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "doc_id", "start", "ids_crc32", "number"], ascending=[False, True, True, True, True], kind="stable")
        sequence, offset = best_fit(shard["length"].to_numpy(), window)
        shard["sequence_id"] = (shard["shard"].to_numpy().astype(np.int64) << 40) + sequence
        shard["offset"] = offset
        return shard.drop(columns=["shard", "number"])

    return dealt.groupBy("shard").applyInPandas(run, schema)


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, shard_pieces: int = 50_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packed(pieces(docs, tokenizer, window, end_id), window, shard_pieces)
