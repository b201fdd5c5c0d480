"""Search of reads that arrive as files: each micro-batch is one batch search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strandlake.config import SearchConfig
from strandlake.plans.search import blastx


def search_stream(spark: SparkSession, folder: str, proteins: DataFrame, out: str, checkpoint: str, config: SearchConfig = SearchConfig()) -> StreamingQuery:
    """Alignments of Parquet files of reads (doc_id, dna) that come into ``folder``, appended to ``out``.

    Reads are independent, so there is no state; a batch that is run again overwrites its own folder.
    """
    reads = spark.readStream.schema("doc_id long, dna string").parquet(folder)

    def search(batch: DataFrame, number: int) -> None:
        blastx(batch, proteins, config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reads.writeStream.foreachBatch(search).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
