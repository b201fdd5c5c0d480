"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Java regular expressions of what lies between the two kinds of words.
SPACES = r"[\x20\x09-\x0D]+"
NO_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """One of the given tables.  A ``heavy`` one, with much work on each row, is dealt to as many
    tasks as there are cores if its scan has fewer, as with one file of one row group; larger
    scans are read as they are."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if heavy and rows.rdd.getNumPartitions() < cores else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a folder of its own; on a cluster
    a missing setting is an error, as each machine would write to its own disk.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut of the lineage that
    outlives executors and is computed once however often it is used."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    plain = F.octet_length(text) == F.length(text)
    # the built-in is far faster, and the same for texts of ASCII characters alone
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def cut(text: Column, between: str) -> Column:
    """The words of a text and one empty string behind them (and before them, if the text starts
    with a separator); null text is empty.  Far faster than to extract the words."""
    return F.split(F.concat(F.coalesce(text, F.lit("")), F.lit(" ")), between, -1)


def words(text: Column, between: str) -> Column:
    """The words of a text in order; null text has none."""
    return F.array_remove(cut(text, between), "")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns that tell rows apart: rows alike in both columns have the same results."""
    return [F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_h")]


def aside(docs: DataFrame, taken: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns named as in ``taken`` under free names, and where each column is."""
    low = {c.lower() for c in [*docs.columns, *taken]}
    mark = "_in"
    while any(c.startswith(mark) for c in low):
        mark += "_"
    clash = {c.lower() for c in taken}
    names = {c: f"{mark}{k}" if c.lower() in clash else c for k, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(there) for c, there in names.items())), names


def finite_vectors(rows: DataFrame, vector: str = "embedding", *keep: str) -> DataFrame:
    """(keep, v): rows whose ``vector`` is not null and holds finite numbers only, as doubles."""
    # Spark holds NaN for larger than infinity, so one comparison leaves out both
    finite = F.expr("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND abs(x) < double('infinity'))")
    return rows.select(*keep, F.col(vector).cast("array<double>").alias("v")).filter(finite)


def matrix(lists: pa.ChunkedArray, width: int, kind: type = np.float64) -> np.ndarray:
    """Lists of numbers as the rows of a matrix of ``width`` columns; shorter ones end in zeros."""
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(flat.offsets.to_numpy()) if len(flat) else np.empty(0, np.int64)
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    out = np.zeros((len(flat), width), kind)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def widest(*tables: pa.Table) -> int:
    """The length of the longest list in the columns ``v`` of some tables."""
    return max((pc.max(pc.list_value_length(t.column("v"))).as_py() or 0 for t in tables if t.num_rows), default=0)
