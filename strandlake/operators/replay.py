"""The order-dependent walk over a peptide: after a hit, its matched letters are skipped.

A walk goes over the positions of one peptide.  At a position it takes the hits that no earlier one
covers on its diagonal, and goes on behind the longest of their matches.  Which hits there are
does not depend on the walk, so they are found and extended in parallel; only the choice among
them is replayed, over sorted partitions with a state that goes on from batch to batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


#: Hits that are Python objects at once.
PIECE = 1 << 12


def query_skip(hits: DataFrame) -> DataFrame:
    """The ``hits`` (doc_id, frame, prot_id, q_pos, r_pos, length, at, match, ...) that a walk takes.

    ``at``: the position in the peptide where the match of ``match`` letters begins, from which the hit
    was extended to ``length`` letters from (``q_pos``, ``r_pos``) on.  Hits without a position are not taken.
    The state is the place to go on from and the last covered place of each diagonal of one peptide.
    """
    columns = hits.columns
    where = [columns.index(c) for c in ("doc_id", "frame", "prot_id", "q_pos", "r_pos", "length", "at", "match")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        peptide, go_on, here, longest = None, 0, -1, 0
        covered: dict[tuple[int, int], int] = {}
        for batch in (b.slice(k, PIECE) for b in batches for k in range(0, b.num_rows, PIECE)):
            taken = np.zeros(batch.num_rows, bool)
            for k, (doc, frame, prot, q, r, length, at, match) in enumerate(zip(*(batch.column(w).to_pylist() for w in where), strict=True)):
                if (doc, frame) != peptide:
                    peptide, go_on, here, longest, covered = (doc, frame), 0, -1, 0, {}
                if at != here:
                    go_on = here + longest + 1 if longest else go_on
                    here, longest = at, 0
                diagonal = prot, q - r
                if at < go_on or covered.get(diagonal, -1) > at:
                    continue
                taken[k] = True
                covered[diagonal] = max(covered.get(diagonal, -1), q + length)
                longest = max(longest, match)
            yield batch.filter(pa.array(taken))

    placed = hits.filter("at IS NOT NULL").repartition("doc_id", "frame").sortWithinPartitions("doc_id", "frame", "at", "prot_id", "r_pos")
    return placed.mapInArrow(run, hits.schema)
