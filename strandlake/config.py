"""Search parameters, in one frozen record."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class SearchConfig:
    #: Name of the score matrix, for its statistics; and its file in the NCBI text format.  Without a
    #: file, letters score ``match`` or ``mismatch``, with the statistics of these scores.
    matrix: str = "BLOSUM80"
    matrix_path: str | None = None
    #: File of statistics (statistics.read_statistics) for matrices and penalties that are not built in.
    statistics_path: str | None = None
    gap_open: int = 11
    gap_extend: int = 2
    #: Penalty of a frame shift; None keeps alignments in one frame.
    frameshift: int | None = 15
    multiplicity: int = 10
    #: (p, q) of the minimizers at whose places alone the base is indexed; None for all places.
    sampling: tuple[int, int] | None = None
    #: Whether a hit's matched letters are skipped, position by position as in a serial search; else all hits count.
    query_skip: bool = False
    max_evalue: float = 1e-3
    min_coverage: int = 0
    dominance: bool = False
    dominance_overlap: float = 0.9
    dominance_score: float = 0.9
    match: int = 6
    mismatch: int = -2
    #: Bases of gaps and shifts, in sum, that an alignment may lie off its seed's diagonal; None: the
    #: longest single gap that the drop allows.
    band: int | None = None


def long_reads(**changes: object) -> SearchConfig:
    return replace(SearchConfig(frameshift=15), **changes)


def short_reads(**changes: object) -> SearchConfig:
    return replace(SearchConfig(frameshift=None), **changes)
