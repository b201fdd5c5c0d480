"""What the findings of round 4 asked for: alignments computed once for the filter, and only where they can reach their score."""

import random

import numpy as np
import pytest

from strandlake.config import long_reads
from strandlake.functions import sequences
from strandlake.functions.sequences import peptides
from strandlake.operators import alignment, extension
from strandlake.plans import search

from .test_round3 import homologies


def test_dominance_aligns_once(spark, monkeypatch):
    rng = random.Random(3)
    reads = [(k, "".join(rng.choice("ACGT") for _ in range(240))) for k in range(6)]
    tables = spark.createDataFrame(reads, "doc_id long, dna string"), spark.createDataFrame([(k, peptides(x)[k % 6]) for k, x in reads], "prot_id long, aa string")
    seen, kernel = spark.sparkContext.accumulator(0), alignment.gapped_by_read

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def watched(*how):
        out = kernel(*how)
        return out.mapInArrow(counted, out.schema)

    monkeypatch.setattr(alignment, "gapped_by_read", watched)
    out = search.blastx(*tables, long_reads(dominance=True)).collect()
    assert {(r["doc_id"], r["prot_id"]) for r in out} >= {(k, k) for k in range(6)}
    assert seen.value == search.blastx(*tables, long_reads()).count()


@pytest.mark.parametrize("how", [(11, 2, 15, 61, 75), (11, 2, None, 61, 75), (5, 1, 8, 40, 30), (1, 3, 2, 200, 99), (0, 1, 1, 60, 12), (3, 1, None, 300, 33)])
def test_the_bound_is_no_less_than_the_score(how):
    rng = random.Random(repr(how))
    rows = homologies(rng, 120)
    for _ in range(20):  # long ones with many gaps and shifts
        dna = "".join(rng.choice("ACGT") for _ in range(900))
        aa = peptides(dna)[0]
        for _ in range(6):
            k = rng.randrange(len(dna))
            dna = dna[:k] + "A" * rng.randrange(8) + dna[k + rng.randrange(8) :]
        rows.append((dna, aa, [(min(3 * r, len(dna) - 1), r) for r in rng.sample(range(len(aa)), 3)]))
    who = np.repeat(np.arange(len(rows)), [len(x[2]) for x in rows])
    q, r = np.array([s for x in rows for s in x[2]], np.int64).T
    batch = alignment.Batch([x[0] for x in rows], [x[1] for x in rows], alignment.score_table(None, 6, -2), *how)
    assert batch.bounded()
    for sign in (1, -1):
        score = batch.best(who, q, r, sign)[0]
        for enough in (10**6, 60, 0):
            bound = batch.most(who, q, r, sign, np.full(len(who), enough))
            assert (bound >= np.minimum(score, enough)).all() and score.max() > 200


def test_only_hopeful_chains_are_aligned(monkeypatch):
    rng = random.Random(4)
    word = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    rows = [(word(600, "ACGT"), word(80, "ARNDCQEGHILKMFPSTWYV"), [(300, 40), (30, 9)]) for _ in range(300)] + homologies(rng, 60)
    table = alignment.score_table(None, 6, -2)
    batch = alignment.Batch([x[0] for x in rows], [x[1] for x in rows], table, 11, 2, 15, 60, 72)
    seeds, least = [x[2] for x in rows], np.full(len(rows), 60)
    aligned, best = [], alignment.Batch.best
    monkeypatch.setattr(alignment.Batch, "best", lambda self, who, *of: (aligned.append(len(who)), best(self, who, *of))[1])
    found = alignment.aligned(batch, seeds, least)
    some = sum(aligned)
    aligned.clear()
    monkeypatch.setattr(alignment.Batch, "bounded", lambda self: False)
    assert sorted(alignment.aligned(batch, seeds, least)) == sorted(found) and len(found) > 10
    assert some < sum(aligned) / 4
    # scores of more kinds are not bounded
    monkeypatch.undo()
    table[ord("L"), ord("I")] = table[ord("I"), ord("L")] = 2
    assert not alignment.Batch(["ACG"], ["T"], table, 11, 2, 15, 60).bounded()
    assert not alignment.aligned(alignment.Batch(["ACG"], ["T"], alignment.score_table(None, 6, -2), 11, 2, 15, 60), [[]], np.ones(1, np.int64))


def test_seeds_come_from_reads_without_peptides_between(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k // 2, "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 2, 8, 9, 90, 700])))) for k in range(40)] + [(50, None), (None, "ACGT" * 30), (None, "ACGT" * 30), (1 << 60, "ACGTT" * 30)]
    reads = spark.createDataFrame(rows, "doc_id long, dna string").coalesce(1)
    proteins = spark.createDataFrame([*((k, peptides(x)[k % 6]) for k, (_, x) in enumerate(rows[:40])), (90, peptides("ACGTT" * 30)[1]), (91, peptides("ACGT" * 30)[4])], "prot_id long, aa string")
    how = (10, alignment.score_table(None, 6, -2), 0.365, 0.168)
    of_peptides = {tuple(r) for r in extension.seeds(sequences.six_frames(reads, keep=False), proteins, *how, origin=True).collect()}
    monkeypatch.setattr(sequences, "six_frames", None)
    got = [tuple(r) for r in extension.seeds(reads, proteins, *how, origin=True).collect()]
    assert set(got) == of_peptides and {r[0] for r in got} >= {None, 1 << 60}
    assert len(search.seeds(reads, proteins, long_reads()).collect()) > 20
